"""Near-duplicate documents: MinHash bands, odd sketches to verify candidates, full sets to confirm links.

1.  One pass computes each text's set of word shingles (64-bit hashes), its fingerprint, MinHash samples, band keys and
    odd sketch: the samples hashed to ``SKETCH_BITS`` positions of a parity bitmap.  The positions where two sketches
    differ are a parity count of the samples that differ, which estimates high similarities closely.
2.  Texts with equal sets form a class; from here on only classes meet.  As many bands as ``MAX_LOSS`` asks for make a
    pair at the threshold meet in at least one bucket.
3.  In each bucket every class is compared with one pivot, which is linear in the bucket.  Filters are the lengths, the
    sketch with a wide margin, and the parity bitmap of the whole set: its differing bits are never more than the sets'
    differing shingles, so that filter loses nothing.  Full sets confirm the pairs, and components are formed.  A further
    round compares the classes outside a bucket's largest component with another pivot from it.
4.  Only where a bucket then still holds several components, classes outside its largest one are compared with all classes
    of other components there, in blocks (large buckets are dealt out by salt).  So every pair that shares a bucket is
    either in one component or has been compared: no link is lost to a cap.

Defined results: a NULL or wordless text has an empty set and links with nothing; fewer words than a shingle make one
shingle of the whole sequence; repeated rows are copies of each other; a document without an id can be linked, and stands
for its group only where no member has an id; other columns are left out of the groups and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import MULTIPLIER, PLAIN_WORD, WordHashes, byte_texts, checked_broadcast, components, mixed, rolling, stored

BAND_ROWS = 5
#: Chance that a pair right at the threshold shares no band.
MAX_LOSS = 1e-6
SKETCH_BITS = 512
PARITY_BITS = 1024
#: Linear rounds with other pivots before the remaining classes are compared with all.
ROUNDS = 1
#: Classes of a bucket per block of the second comparison.
BLOCK = 2000
CHUNK = 4096


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MAX_LOSS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def most_different(percent: int) -> int:
    """Differing sketch bits up to which a pair may reach the similarity: five and four deviations of margin."""
    samples, j = n_bands(percent) * BAND_ROWS, percent / 100
    apart = samples * (1 - j) + 5 * math.sqrt(samples * j * (1 - j))
    bits = SKETCH_BITS / 2 * (1 - math.exp(-4 * apart / SKETCH_BITS))
    return math.ceil(bits + 4 * math.sqrt(SKETCH_BITS / 4 * (1 - math.exp(-8 * apart / SKETCH_BITS))))


def shingle_set(text: bytes | None, size: int, known: WordHashes) -> np.ndarray:
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(rolling(known.of(words), min(size, len(words))))


def parity(places: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of the places that occur an odd number of times, as 64-bit numbers."""
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Sampler:
    """MinHash samples of a set, and what is made of them."""

    def __init__(self, percent: int):
        self.bands = n_bands(percent)
        count = self.bands * BAND_ROWS
        seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * MULTIPLIER)
        self.factors, self.terms = seeds[:count] | np.uint64(1), seeds[count:]

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), CHUNK):
            part = shingles[i : i + CHUNK, None] * self.factors[None, :] + self.terms[None, :]
            np.minimum(out, part.min(axis=0), out=out)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        out = np.arange(self.bands, dtype=np.uint64)
        for row in samples.reshape(self.bands, BAND_ROWS).T:
            out = mixed(out * MULTIPLIER + row)
        return out.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        places = mixed(samples ^ self.terms) % np.uint64(SKETCH_BITS)
        return parity(places, SKETCH_BITS)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key (hash of the text), n (set size), class (fingerprint of the set), band keys, sketch and parity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sampler = WordHashes(), Sampler(percent)
        for batch in batches:
            sizes, classes, keys, sketches, parities = [], [], [], [], []
            for text in byte_texts(batch.column(2)):
                shingles = shingle_set(text, size, known)
                sizes.append(len(shingles))
                if len(shingles):
                    samples = sampler.samples(shingles)
                    classes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    keys.append(sampler.keys(samples))
                    sketches.append(sampler.sketch(samples))
                    parities.append(parity(shingles % np.uint64(PARITY_BITS), PARITY_BITS))
                else:
                    classes.append(None)
                    keys.append(None)
                    sketches.append(None)
                    parities.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs), pa.array(parities, longs)],
                ["doc_id", "key", "n", "class", "bands", "sketch", "parity"],
            )

    return rows.mapInArrow(sign, f"doc_id {kind}, key long, n long, class binary, bands array<long>, sketch array<long>, parity array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class and its full set, for the classes and text keys wanted."""
    texts = docs.select(F.xxhash64("text").alias("k"), "text").join(checked_broadcast(wanted.select("key")), F.col("k") == F.col("key"), "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, known) for t in byte_texts(batch.column(1))]
            classes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "shingles"]
            )

    # Copies of one text give one row; map-side aggregation keeps a hot text from meeting in one task.
    found = texts.mapInArrow(shingle, "class binary, shingles array<long>").groupBy("class").agg(F.first("shingles").alias("shingles"))
    return found.join(wanted.select("class"), "class", "left_semi")


FACTS = ("n", "sketch", "parity")


def differing(a: Column, b: Column, bits: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def near(percent: int) -> Column:
    """Whether the classes a and b may be similar enough, from their facts."""
    c = F.col
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    sketch = differing(c("sketch_a"), c("sketch_b"), SKETCH_BITS) <= most_different(percent)
    whole = (100 + percent) * differing(c("parity_a"), c("parity_b"), PARITY_BITS) <= (100 - percent) * (c("n_a") + c("n_b"))
    return sizes & sketch & whole


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b") - common).alias("union")).where(
        100 * F.col("common") >= percent * F.col("union")
    ).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """class and root: the components of the classes that have a link."""
    buckets = classes.select("class", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.min("class").alias("pivot")).where("total > 1")
    members = stored(buckets.join(pivots, "bucket"), "neardup-members")
    wanted = members.select("class").distinct().join(classes.select("class", F.col("first.key").alias("key")), "class")
    sets = stored(sets_of(docs, stored(wanted, "neardup-wanted"), size), "neardup-sets")

    facts = classes.select("class", *FACTS)
    side = lambda name: facts.select(F.col("class").alias(name), *[F.col(f).alias(f"{f}_{name}") for f in FACTS])
    close = near(percent)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(close).select("a", "b")
        return stored(confirmed(stored(pairs, "neardup-pairs"), sets, percent), "neardup-links")

    edges = linked(members.where("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")))
    roots = components(edges)
    for number in range(ROUNDS + 1):
        open_rows = stored(unjoined(members, roots, number), "neardup-open")
        if number == ROUNDS or open_rows.isEmpty():
            break
        pivoted = open_rows.where(F.col("root") != F.col("largest")).select(F.col("pivot").alias("a"), F.col("class").alias("b"))
        found = linked(pivoted)
        if found.isEmpty():
            break
        # The components found so far stand for their links.
        roots = components(found.unionByName(as_links(roots)))

    few = open_rows.where("root != largest").join(facts, "class").withColumn("salts", F.ceil(F.col("total") / BLOCK).cast("int"))
    few = few.select(
        "bucket", F.col("class").alias("a"), F.col("root").alias("root_a"), *[F.col(f).alias(f"{f}_a") for f in FACTS],
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    every = open_rows.join(facts, "class").select(
        "bucket", F.col("class").alias("b"), F.col("root").alias("root_b"), *[F.col(f).alias(f"{f}_b") for f in FACTS],
        "largest", F.pmod(F.xxhash64("class"), F.ceil(F.col("total") / BLOCK)).cast("int").alias("salt"),
    )
    once = (F.col("root_b") == F.col("largest")) | (F.col("a") < F.col("b"))
    rest = few.join(every, ["bucket", "salt"]).where((F.col("root_a") != F.col("root_b")) & once & close)
    more = stored(confirmed(stored(rest.select("a", "b").distinct(), "neardup-pairs"), sets, percent), "neardup-links")
    return roots if more.isEmpty() else components(more.unionByName(as_links(roots)))


def as_links(roots: DataFrame) -> DataFrame:
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def unjoined(members: DataFrame, roots: DataFrame, number: int) -> DataFrame:
    """The rows of buckets that hold several components: bucket, total, class, root, largest component and a pivot from it."""
    placed = members.join(roots, members["class"] == roots["node"], "left")
    placed = placed.select("bucket", "total", "class", F.coalesce("root", "class").alias("root"))
    # Another pivot in each bucket, so that a class meets several of a large component in one round.
    turn = F.xxhash64("class", "bucket", F.lit(number))
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(turn.alias("turn"), "class")).alias("first"))
    largest = F.max_by(F.struct("root", F.col("first.class").alias("pivot")), F.struct("n", "root"))
    buckets = parts.groupBy("bucket").agg(largest.alias("of"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    out = placed.join(buckets, "bucket")
    return out.select("bucket", "total", "class", "root", F.col("of.root").alias("largest"), F.col("of.pivot").alias("pivot"))


def find_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key (hash of the text), n (set size) and first: the row (id, key) that stands for the group."""
    signed = stored(signatures(docs, size, percent), "neardup-signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    classes = signed.where("n > 0").groupBy("class").agg(
        F.min(row).alias("first"), *[F.first(c).alias(c) for c in ("bands", *FACTS)]
    )
    classes = stored(classes, "neardup-classes")
    roots = links(docs, classes, size, percent)
    firsts = classes.join(roots, classes["class"] == roots["node"]).groupBy("root").agg(F.min("first").alias("group_first"))
    grouped = roots.join(firsts, "root").select(F.col("node").alias("class"), "group_first")
    stands = classes.join(grouped, "class", "left").select("class", F.coalesce("group_first", "first").alias("first"))
    out = signed.select("doc_id", "key", "n", "class").join(stands, "class", "left")
    return out.select("doc_id", "key", "n", F.coalesce("first", row).alias("first"))


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; documents without words all stay."""
    groups = find_groups(docs, size, percent)
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    kept = groups.where(mine & (F.col("n") > 0)).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    worded = F.coalesce(F.col("text").rlike(PLAIN_WORD), F.lit(False))
    rows = docs.where(worded).withColumn("__own", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")))
    # Repeated rows of a document that stands for its group are copies of it too.
    return rows.dropDuplicates(["__id", "__key"]).select(*docs.columns).unionByName(docs.where(~worded))


def group_digest(docs: DataFrame) -> DataFrame:
    groups = find_groups(docs.select("doc_id", "text"), 3, 85)
    first = F.col("first.doc_id")
    return groups.select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"), F.col("doc_id").eqNullSafe(first).alias("kept"))
