"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are found by pattern and checked (parts of an address, Luhn's sum, numbers of digits).  They also label the spans that the
tagger is trained on: windows around them, some of them run together, as neighbours swallow each other in a pattern, and windows without any.  A
text is cut into windows of ``WINDOW`` characters, each overlapping half of the next; every window is decoded, pieces that a
window's edge cuts are joined with the next window's, and from all pieces of a text the disjoint ones of the greatest total
score are taken, a score being how far the tags' emissions lie above those of no span.  A span so found is reported if it passes its
kind's check as a whole, stands apart from letters and digits, and overlaps no base span: that is the second of two numbers
in a row, a telephone number that runs into another number, a number after a wrong one.

A span of any kind holds a digit or an ``@``; so windows are only decoded if they or a neighbour hold one outside the base spans, and
all others can't add a span.

The tagger learns from at most ``SAMPLE`` windows of each kind and as many without a span (the smallest hashes of all
documents'), on the driver; base spans and decoding cover whole texts.  No labelled span in the corpus: no tagger, nothing added.

Defined results: a NULL or empty text has no spans; offsets are code points; a very long text is decoded window by window, ``BATCH`` at a
time; spans of a kind that tie in the score keep the one that ends first; repeated rows give a row each; a NULL id is an id
like another; other columns of the documents are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm import tagger
from tillwatch.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WHOLE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ADDRESS, CARD, PHONE)

WINDOW = 96
STRIDE = WINDOW // 2
HIDDEN = 24
BATCH = 1024
#: Labelled windows of each kind, and training.
SAMPLE = 500
STEPS = 160
TRAIN_BATCH = 96
RATE = 0.02
SEED = 11
#: Code points above the last printable character share a class; so do the control characters.
CLASSES = 98
TAGS = 1 + 2 * len(KINDS)

SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
Span = tuple[int, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        value = int(c) << (i & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def passes(kind: int, match: str) -> bool:
    """The check of a kind's match."""
    if kind == 1:
        parts = [p.lstrip("0") for p in match.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == 2:
        number = digits(match)
        return 14 <= len(number) <= 19 and luhn(number)
    return kind == 0 or 10 <= len(digits(match)) <= 15


def emails(text: str) -> Iterator[Span]:
    """The pattern's matches, found from each @ outwards, so that a long run without one costs nothing."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end(), 0
            done = m.end()


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base matches by start, then kind; and the longer matches that fail their check."""
    found = list(emails(text)) if "@" in text else []
    failed = []
    for kind, pattern in ((1, ADDRESS), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if passes(kind, m[0]):
                found.append((*m.span(), kind))
            elif len(m[0]) >= 10:
                failed.append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], s[2])), failed


def codes_of(text: str) -> np.ndarray:
    """Classes of characters: printable ASCII one by one, line breaks, other control characters and all beyond."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    out = np.where(points < 127, points.astype(np.int64) - 30, CLASSES - 1)
    out[points < 32] = 1
    return out.astype(np.int16)


def tags_of(spans: list[Span], start: int, width: int) -> np.ndarray:
    """Tags of a window: 0, or 1 + 2 * kind at a span's first character and 2 + 2 * kind inside; earlier spans go first."""
    out = np.zeros(width, dtype=np.int8)
    reach = 0
    for s, e, kind in spans:
        if s >= reach:
            reach = e
            a, b = max(s - start, 0), min(e - start, width)
            if a < b:
                out[a:b] = 2 + 2 * kind
                if s >= start:
                    out[a] = 1 + 2 * kind
    return out


def examples(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (windows, WINDOW) of at most `sample` windows for each kind and without spans, the smallest hashes."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The smallest of all are among the smallest of each task.
        best: list[dict[int, tuple[bytes, bytes]]] = [{} for _ in range(len(KINDS) + 1)]
        edge = [2**64] * len(best)

        def offer(kind: int, text: str, middle: int, spans: list[Span], failed: list[Span]) -> None:
            start = max(0, middle - WINDOW + xxhash.xxh3_64_intdigest(text[max(0, middle - 8) : middle + 8].encode()) % WINDOW)
            start = max(0, min(start, len(text) - WINDOW))
            piece = text[start : start + WINDOW]
            mark = xxhash.xxh3_64_intdigest(piece.encode(), seed=SEED)
            if mark >= edge[kind] or any(s < start + WINDOW and start < e for s, e, _ in failed):
                return
            inside = [s for s in spans if s[0] < start + WINDOW and start < s[1]]
            if kind == len(KINDS) and inside:
                return
            pad = WINDOW - len(piece)
            codes = np.pad(codes_of(piece), (0, pad))
            best[kind][mark] = codes.astype("<i2").tobytes(), tags_of(inside, start, WINDOW).tobytes()
            if len(best[kind]) >= 2 * sample:
                best[kind] = dict(sorted(best[kind].items())[:sample])
                edge[kind] = max(best[kind])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans, failed = base_spans(text)
                for start, end, kind in spans:
                    offer(kind, text, (start + end) // 2, spans, failed)
                offer(len(KINDS), text, xxhash.xxh3_64_intdigest(text.encode()) % len(text), spans, failed)
                for s, e, _ in failed[:1]:
                    offer(len(KINDS), text, max(0, s - WINDOW // 2), spans, failed)
        rows = [(kind, mark - 2**63, *pair) for kind, kept in enumerate(best) for mark, pair in sorted(kept.items())[:sample]]
        if rows:
            kind, mark, codes, tags = zip(*rows)
            columns = [pa.array(kind, pa.int32()), pa.array(mark, pa.int64()), pa.array(codes, pa.binary()), pa.array(tags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "mark", "codes", "tags"])

    found = stored(docs.select("text").mapInArrow(pick, "kind int, mark long, codes binary, tags binary"), "personal-examples")
    rows = []
    for kind in range(len(KINDS) + 1):
        # Copies share a mark.
        chosen = found.where(F.col("kind") == kind).groupBy("mark").agg(F.min_by(F.struct("codes", "tags"), "codes").alias("pair"))
        rows += chosen.orderBy("mark").limit(sample).select("pair.*").collect()
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), dtype="<i2").reshape(-1, WINDOW)
    tags = np.frombuffer(b"".join(r["tags"] for r in rows), dtype=np.int8).reshape(-1, WINDOW)
    return codes, tags


def neighbours(codes: np.ndarray, tags: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows in which a span of one example follows another's after a blank, each within its own surroundings."""
    rng = np.random.default_rng(seed)
    spans = []
    for i, row in enumerate(tags):
        for s in np.flatnonzero((row > 0) & (row % 2 == 1)):
            e = int(s) + 1
            while e < WINDOW and row[e] == row[s] + 1:
                e += 1
            if e < WINDOW:
                spans.append((i, int(s), e))
    out_codes, out_tags = [], []
    blank = np.array([2], dtype=codes.dtype)
    none = np.zeros(1, dtype=tags.dtype)
    for k in rng.permutation(len(spans)).tolist():
        i, s, e = spans[k]
        j, s2, e2 = spans[int(rng.integers(len(spans)))]
        row = np.concatenate([codes[i, :e], blank, codes[j, s2:]])
        tag = np.concatenate([tags[i, :e], none, tags[j, s2:]])
        start = int(rng.integers(0, min(s, max(len(row) - WINDOW, 0)) + 1))
        row, tag = row[start : start + WINDOW], tag[start : start + WINDOW]
        out_codes.append(np.pad(row, (0, WINDOW - len(row))))
        out_tags.append(np.pad(tag, (0, WINDOW - len(tag))))
    empty = np.empty((0, WINDOW), dtype=codes.dtype)
    return np.array(out_codes or empty), np.array(out_tags or empty)


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> tagger.Params | None:
    """The tagger of a corpus; None if it holds no labelled span."""
    codes, tags = examples(docs, sample)
    if not (tags > 0).any():
        return None
    more_codes, more_tags = neighbours(codes, tags)
    codes, tags = np.concatenate([codes, more_codes]).astype(np.int64), np.concatenate([tags, more_tags]).astype(np.int64)
    params = tagger.fresh(CLASSES, HIDDEN, TAGS, SEED)
    tagger.fit(params, codes, tags, steps, TRAIN_BATCH, RATE, SEED)
    return params


def window_starts(codes: np.ndarray, base: list[Span]) -> list[int]:
    """Starts of the windows to decode: those that hold, or whose neighbour holds, a digit or @ outside the base spans."""
    speaks = ((codes >= 18) & (codes <= 27)) | (codes == 34)
    for s, e, _ in base:
        speaks[s:e] = False
    at = np.flatnonzero(speaks)
    if not len(at):
        return []
    last = max(0, -(-(len(codes) - WINDOW) // STRIDE))
    slots = np.unique(np.concatenate([at // STRIDE + d for d in (-2, -1, 0, 1)]))
    return [int(i) * STRIDE for i in slots if 0 <= i <= last]


def pieces(path: np.ndarray, emissions: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, float, bool, bool]]:
    """(start, end, kind, score, cut at the left, cut at the right) of a decoded window's spans."""
    out = []
    width = min(WINDOW, length - start)
    kinds = (path[:width] - 1) // 2
    edges = np.flatnonzero((kinds[1:] != kinds[:-1]) | ((path[1:width] > 0) & (path[1:width] % 2 == 1))) + 1
    bounds = [0, *edges.tolist(), width]
    for a, b in zip(bounds, bounds[1:]):
        if path[a] > 0:
            at = np.arange(a, b)
            score = float((emissions[at, path[at]] - emissions[at, 0]).sum())
            out.append((start + a, start + b, int(kinds[a]), score, a == 0 and start > 0, b == width and start + width < length))
    return out


def reconciled(found: list[tuple[int, int, int, float, bool, bool]]) -> list[Span]:
    """Cut pieces joined with those they overlap, then the disjoint spans of the greatest total score."""
    spans: list[list] = []
    for s, e, kind, score, left, right in sorted(found):
        if spans and spans[-1][2] == kind and s <= spans[-1][1] and (left or spans[-1][5]):
            last = spans[-1]
            share = (e - max(last[1], s)) / (e - s) if e > last[1] else 0.0
            last[3] += score * share
            if e >= last[1]:
                last[1], last[5] = e, right
        else:
            spans.append([s, e, kind, score, left, right])
    ordered = sorted({(e, s, kind, score) for s, e, kind, score, _, _ in spans if score > 0})
    ends = [o[0] for o in ordered]
    best: list[tuple[float, int]] = [(0.0, -1)]  # of the first i spans: the total, and the last one taken
    for i, (e, s, _, score) in enumerate(ordered):
        before = bisect_right(ends, s, 0, i)
        taken = best[before][0] + score
        best.append((taken, i) if taken > best[i][0] else (best[i][0], -1))
    out, i = [], len(ordered)
    while i:
        if best[i][1] < 0:
            i -= 1
            continue
        e, s, kind, _ = ordered[i - 1]
        out.append((s, e, kind))
        i = bisect_right(ends, s, 0, i - 1)
    return out[::-1]


def apart(text: str, start: int, end: int) -> bool:
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return not any(c.isalnum() for c in beside)


def accepted(text: str, spans: list[Span], base: list[Span]) -> list[Span]:
    """The tagger's spans that pass their kind's check, stand apart and overlap no base span."""
    starts = [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
    out = []
    for start, end, kind in spans:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        piece = text[start:end]
        before = bisect_right(starts, end - 1)
        free = not before or reach[before - 1] <= start
        if free and WHOLE[kind].fullmatch(piece) and passes(kind, piece) and apart(text, start, end):
            out.append((start, end, kind))
    return out


def tagged(params: tagger.Params, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """The tagger's reconciled spans of each text."""
    jobs: list[tuple[int, int]] = []
    coded = []
    for i, text in enumerate(texts):
        # Without a digit or @ nothing is decoded.
        codes = codes_of(text)
        coded.append(codes)
        jobs += [(i, start) for start in window_starts(codes, bases[i])]
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(jobs), BATCH):
        part = jobs[k : k + BATCH]
        codes = np.zeros((len(part), WINDOW), dtype=np.int64)
        for row, (i, start) in enumerate(part):
            piece = coded[i][start : start + WINDOW]
            codes[row, : len(piece)] = piece
        emissions, _ = tagger.run(params, codes)
        paths = tagger.best_paths(params, emissions)
        for row in np.flatnonzero(paths.any(axis=1)).tolist():
            i, start = part[row]
            found[i] += pieces(paths[row], emissions[:, row], start, len(coded[i]))
    return [reconciled(f) if f else [] for f in found]


def find_personal(docs: DataFrame, params: tagger.Params | None) -> DataFrame:
    """doc_id, base spans and all spans of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        listed = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t)[0] for t in texts]
            more = tagged(model, texts, bases) if model is not None else [[] for _ in texts]
            every = [sorted(b + accepted(t, m, b), key=lambda s: (s[0], s[2])) for t, m, b in zip(texts, more, bases)]
            columns = [batch.column(0), pa.array(map(listed, bases), SPANS), pa.array(map(listed, every), SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    span = "array<struct<start:int,end:int,kind:int>>"
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, base {span}, spans {span}")


def joined(spans: str):
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    found = find_personal(slim, train(slim))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
