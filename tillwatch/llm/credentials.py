"""Secret scan with multipart credential linking.

Base kinds are found by pattern: assignments of a secret, access identifiers, hexadecimal runs.  The method adds weak
candidates - identifier-like, secret-like and endpoint parts that would be noise alone - and reports one only where a
complementary part of another role is at most ``SCOPE`` characters away, from the end of one to the start of the other.
An endpoint that a base span overlaps is not reported, but parts beside it are.  The link is an interval join of the parts
on document and scope bucket: a part is put in all buckets it covers and both neighbouring ones.  Parts are of at least
``MIN_PART`` characters and don't overlap within a role, so a bucket holds a bounded number of them and the join stays
linear in the text.

A secret-like part is a run of at least 20 characters that holds a digit, a capital and a small letter.

Defined results: a very long text takes time in proportion to its length, blanks or none; a NULL text is empty and has no spans; offsets are code points; repeated rows give a row each, as parts
are keyed by id and hash of the text; a NULL id is an id like another; other columns of the documents are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import stored

SCOPE = 200
MIN_PART = 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run shorter than 16 is dropped anyway, and a longer one is found whole.
HEX = re.compile(r"[0-9a-f]{16,}")
# Weak parts.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{12,32}(?![A-Za-z0-9])")
# Tried at the beginning of a run only and never given back, so that a text without blanks costs no more than another.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![=])")
SECRET_CLASSES = tuple(map(re.compile, ("[0-9]", "[A-Z]", "[a-z]")))
ENDPOINT = re.compile(r"\b(?:https?|s3|wss?)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}")

BASE_KINDS = ("assign", "access", "hex")
#: A "link" is an endpoint that only links others.
KINDS = (*BASE_KINDS, "identifier", "secret", "endpoint", "link")
ROLE_OF = {"assign": "secret", "access": "identifier", "link": "endpoint"}

SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
SCANNED = "doc_id {id}, key long, base array<struct<start:int,end:int,kind:int>>, weak array<struct<start:int,end:int,kind:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches, by start, then kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that no base span overlaps."""
    found = [(*m.span(), kind) for kind, pattern in ((3, IDENTIFIER), (5, ENDPOINT)) for m in pattern.finditer(text)]
    found += [(*m.span(), 4) for m in SECRET.finditer(text) if all(c.search(m[0]) for c in SECRET_CLASSES)]
    # The furthest end of the base spans that begin before a place.
    starts = [start for start, _, _ in base]
    reach = list(accumulate((end for _, end, _ in base), max, initial=0))
    return [(start, end, kind) for start, end, kind in sorted(found) if reach[bisect_left(starts, end)] <= start]


def link_parts(text: str, weak: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The endpoints that are no weak parts, because a base span overlaps them."""
    reported = {(start, end) for start, end, kind in weak if kind == 5}
    return [(*m.span(), 6) for m in ENDPOINT.finditer(text) if m.span() not in reported]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), base spans, and weak and link parts of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak = [], []
            for text in batch.column(2).to_pylist():
                strong = base_spans(text or "")
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in strong])
                parts = weak_spans(text or "", strong)
                parts += link_parts(text or "", parts)
                weak.append([{"start": s, "end": e, "kind": k} for s, e, k in parts])
            columns = [batch.column(0), batch.column(1), pa.array(base, SPANS), pa.array(weak, SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "base", "weak"])

    return rows.mapInArrow(search, SCANNED.format(id=kind))


def linked(scanned: DataFrame) -> DataFrame:
    """doc_id, key and the weak spans that have a part of another role within the scope."""
    role = F.element_at(F.array(*[F.lit(ROLE_OF.get(k, k)) for k in KINDS]), F.col("part.kind") + 1)
    parts = scanned.select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("part")).where(F.col("part.kind") != 2)
    parts = parts.select("doc_id", "key", "part", role.alias("role")).distinct()
    first, last = F.floor(F.col("part.start") / SCOPE), F.floor(F.col("part.end") / SCOPE)
    weak = parts.where(F.col("part.kind").between(3, 5))
    weak = weak.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "part", "role", F.explode(F.sequence(first, last)).alias("bucket"))
    near = parts.select("doc_id", "key", F.col("part").alias("other"), F.col("role").alias("other_role"), F.explode(F.sequence(first - 1, last + 1)).alias("in"))
    close = F.greatest(F.col("part.start") - F.col("other.end"), F.col("other.start") - F.col("part.end")) <= SCOPE
    pairs = weak.join(
        near,
        weak["d"].eqNullSafe(near["doc_id"]) & (F.col("k") == F.col("key")) & (F.col("bucket") == F.col("in")) & (F.col("role") != F.col("other_role")) & close,
        "left_semi",
    )
    return pairs.groupBy("d", "k").agg(F.collect_set("part").alias("added"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and all spans of every text."""
    scanned = stored(scan(docs), "secrets")
    added = linked(scanned)
    out = scanned.join(added, scanned["doc_id"].eqNullSafe(F.col("d")) & (scanned["key"] == F.col("k")), "left")
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    every = F.array_sort(F.concat("base", F.coalesce("added", empty)), lambda a, b: F.signum(order(a) - order(b)).cast("int"))
    return out.select("doc_id", "base", every.alias("spans"))


def order(span):
    return span["start"].cast("long") * len(KINDS) + span["kind"]


def listed(spans: str):
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
