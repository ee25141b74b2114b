"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its words, lower-cased (A-Z).  Every line with a word takes part; lines without one are left alone.  A
line goes if a line that stands earlier, by (doc_id, text hash, line number), has the same set or a Jaccard similarity of
at least ``PERCENT`` / 100 - whether or not that earlier line stays.

1.  Words are counted over all documents, in ``COUNT_BUCKETS`` hash buckets: the bounded table that orders tokens by
    rarity (bucket count, then hash - a total order, so the prefix filter stays exact whatever falls together).
2.  Lines with equal sets form a class, numbered in the order of their first lines.  Each class is posted under the
    tokens of its prefix, rarest first, with set size, position and a parity bitmap of its tokens: 64 bits, and 256 more for
    sets of ``LONG`` tokens and more.  A token that
    occurs ``PAIR_WORDS`` times or more is posted together with each later token of the prefix made longer by one: two similar
    sets share two tokens there, so sets whose first common token is frequent meet under it and the second.  Posted tokens
    and pairs are cut to 32 bits: what falls together there adds candidates and loses none.  Sets smaller than
    ``LEAST_POSTED`` are similar to equal sets only; their class says all, and they are not posted.
3.  In each list a class is compared with the list's first class; this is linear, and settles the large groups of
    near copies.  Very frequent tokens are salted, each part having a first class of its own.  Lists are made, and joined
    in the next step, for ``RANGES`` ranges of tokens in turn.
4.  Classes still unsettled are joined with all earlier classes of their lists.  Length, position and bitmap (an exact
    lower bound of the sets' difference) filter inside both joins; a bitmap of 256 bits, then the full sets confirm.

Defined results: a NULL text has no lines and stays NULL; repeated rows (same id and text) are one document here and get the
same result; documents without an id come last; a NULL id is an id like another; other columns are kept, and ``n_chars``,
where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import MULTIPLIER, checked_broadcast, mixed, stored

PERCENT = 80
MIN_TOKENS = 1
#: The smallest set that a set of one token more can be similar to.
LEAST_POSTED = -(-PERCENT // (100 - PERCENT))
COUNT_BUCKETS = 1 << 18
#: A token is posted in pairs from so many words on.  Far fewer would multiply the postings of the rarer ones, whose lists
#: the filters can manage.
PAIR_WORDS = 20_000
#: A token is salted from so many lines on, and from so many times the mean bucket on.
HOT_LINES, HOT_FACTOR = 200_000, 8
#: From so many tokens on a posting carries a wider bitmap too: 64 bits tell long lines no longer apart.
LONG = 64
#: 64-bit words of the parity bitmap that candidate pairs are compared by before their sets.
WIDE = 4
#: The postings' lists are made and joined in so many ranges of tokens, one after another.
RANGES = 4
WIDE_NAMES = tuple(f"wide_{k}" for k in range(WIDE))
#: Bytes of text whose lines are split together.
BLOCK_BYTES = 1 << 22


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """First row and texts of runs of some ``BLOCK_BYTES`` bytes, or of one longer text; NULL is an empty text."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")), start + 1)
        yield start, texts.slice(start, stop - start)
        start = stop


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct words, and each word's place among them."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    raw = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct.cast(pa.binary())), b"")[0].as_py()
    ends = np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False)).tolist()
    hashed = (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *ends], ends))
    hashes = np.fromiter(hashed, dtype=np.uint64, count=len(distinct))
    return hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def words_only(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lists of pieces, and the list each stands in."""
    flat, parent = pieces.flatten(), pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    words = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(words), parent[words.to_numpy(zero_copy_only=False)]


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each line; line and place of each word; hashes by place."""
    lines = pc.split_pattern(pc.ascii_lower(texts), "\n")
    rows = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.arange(len(rows)) - np.searchsorted(rows, rows)
    words, line = words_only(pc.ascii_split_whitespace(lines.flatten()))
    hashes, place = word_hashes(words)
    return rows, numbers, line.astype(np.int64), place, hashes


def line_sets(line: np.ndarray, place: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines' distinct tokens, line after line in the given order of the hashes: line and place in ``hashes[order]``."""
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    bits = len(order).bit_length()
    both = np.sort(line << bits | rank[place])
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both >> bits, both & ((1 << bits) - 1)


def token_counts(docs: DataFrame) -> np.ndarray:
    """How many words of the corpus fall into each hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, texts in text_blocks(batch.column(0)):
                words, _ = words_only(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
                hashes, place = word_hashes(words)
                np.add.at(totals, (hashes % np.uint64(COUNT_BUCKETS)).astype(np.int64), np.bincount(place, minlength=len(hashes)))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNT_BUCKETS, dtype=np.int64)
    table = counts.toArrow()  # at most COUNT_BUCKETS rows
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def prefix_size(size: int) -> int:
    return size + (-size * PERCENT // 100) + 1  # size - ceil(size * PERCENT / 100) + 1


def split_lines(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row per line that takes part: doc_id, key, line, class (of the set), size, bitmap, prefix tokens and salts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = shared.value
        hot = max(HOT_LINES, HOT_FACTOR * int(df.mean()))
        for batch in batches:
            for first_row, texts in text_blocks(batch.column(2)):
                rows, numbers, line, place, hashes = line_words(texts)
                # The block's tokens by rarity; a line's set is then its distinct ranks in rising order.
                often = df[(hashes % np.uint64(COUNT_BUCKETS)).astype(np.int64)]
                order = np.lexsort((hashes, often))
                line, ranks = line_sets(line, place, hashes, order)
                size = np.bincount(line, minlength=len(rows))
                taking = size >= MIN_TOKENS
                if not taking.any():
                    continue
                ranks, size = ranks[taking[line]], size[taking]
                tokens, often = hashes[order][ranks], often[order][ranks]
                ends = np.cumsum(size)
                bitmaps = np.bitwise_xor.reduceat(np.uint64(1) << (tokens >> np.uint64(58)), ends - size)
                long_lines = size >= LONG
                wide = wide_bitmaps(tokens, ends - size)[:, long_lines]
                wide_offsets = np.concatenate(([0], np.cumsum(np.where(long_lines, WIDE, 0)))).astype(np.int32)
                raw = tokens.tobytes()
                classes = [xxhash.xxh3_128_digest(raw[8 * (e - n) : 8 * e]) for e, n in zip(ends.tolist(), size.tolist())]

                n_first = np.where(size >= LEAST_POSTED, prefix_size(size), 0)
                position = np.arange(len(tokens)) - np.repeat(ends - size, size)
                one = np.flatnonzero(position < np.repeat(n_first, size))
                owner, at = np.repeat(np.arange(len(size)), n_first), position[one]
                # A rare token once, a frequent one with each that follows it in the prefix and one place beyond.
                paired = often[one] >= PAIR_WORDS
                times = np.where(paired, n_first[owner] - at, 1)
                following = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                one, owner, paired = np.repeat(one, times), np.repeat(owner, times), np.repeat(paired, times)
                other = np.where(paired, one + 1 + following, one)
                posted = np.where(paired, mixed(tokens[one] * MULTIPLIER + tokens[other]), tokens[one])
                # What two sets can have in common from here on: the token, and all from the other one on.
                ats = np.where(paired, position[other] - 1, position[one]).astype(np.int32)
                parts = often[one] // hot + 1
                turn = np.frombuffer(b"".join(c[:4] for c in classes), dtype=np.uint32).astype(np.int64)
                salts = np.where(parts > 1, turn[owner] % parts + 1, 0).astype(np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(size))))).astype(np.int32))

                places = pa.array(first_row + rows[taking])
                columns = [
                    batch.column(0).take(places), batch.column(1).take(places), pa.array(numbers[taking].astype(np.int32)), pa.array(classes, pa.binary()),
                    pa.array(size.astype(np.int32)), pa.array(bitmaps.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(posted.astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(salts)), pa.ListArray.from_arrays(offsets, pa.array(ats)),
                    pa.ListArray.from_arrays(pa.array(wide_offsets), pa.array(wide.T.ravel().view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "line", "class", "size", "bitmap", "prefix", "salts", "ats", "wide"])

    schema = f"doc_id {kind}, key long, line int, class binary, size int, bitmap long, prefix array<int>, salts array<int>, ats array<int>, wide array<long>"
    return rows.mapInArrow(split, schema)


def wide_bitmaps(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parity bitmaps of WIDE words (a row a word) of sets that begin at `starts`."""
    index = tokens >> np.uint64(56)
    bit = np.uint64(1) << (index & np.uint64(63))
    return np.array([np.bitwise_xor.reduceat(np.where(index >> np.uint64(6) == k, bit, np.uint64(0)), starts) for k in range(WIDE)])


def may_match(x: str, y: str) -> Column:
    """Length, positional and bitmap filter of the postings x and y of one token."""
    c = lambda side, name: F.col(f"{side}_{name}")
    sizes = c(x, "size") + c(y, "size")
    length = 100 * F.least(c(x, "size"), c(y, "size")) >= PERCENT * F.greatest(c(x, "size"), c(y, "size"))
    # Needed in common: PERCENT / (100 + PERCENT) of both sizes together.  At most the token itself and what follows.
    reach = F.least(c(x, "size") - c(x, "at"), c(y, "size") - c(y, "at"))
    position = (100 + PERCENT) * reach >= PERCENT * sizes
    apart = F.bit_count(c(x, "bitmap").bitwiseXOR(c(y, "bitmap")))
    close = (100 + PERCENT) * apart <= (100 - PERCENT) * sizes
    both = (c(x, "size") >= LONG) & (c(y, "size") >= LONG)
    wide = reduce(add, [F.bit_count(F.get(c(x, "wide"), k).bitwiseXOR(F.get(c(y, "wide"), k))) for k in range(WIDE)])
    return length & position & close & (~both | ((100 + PERCENT) * wide <= (100 - PERCENT) * sizes))


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """number, tokens and wide parity bitmap of the wanted classes, read from their first lines only."""
    places = F.collect_list(F.struct(F.col("first.line").alias("line"), "number")).alias("places")
    by_text = stored(wanted.groupBy(F.col("first.key").alias("k")).agg(places), "lines-wanted")
    texts = docs.select(F.xxhash64("text").alias("own"), "text").join(checked_broadcast(by_text), F.col("own") == F.col("k"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, texts in text_blocks(batch.column(0)):
                rows, _, line, place, hashes = line_words(texts)
                asked = batch.column(1).slice(first_row, len(texts))
                row, asked = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False), asked.flatten()
                at = np.searchsorted(rows, row) + asked.field("line").to_numpy(zero_copy_only=False)
                wanted = np.isin(np.arange(len(rows)), at)
                mine = wanted[line]
                order = np.argsort(hashes)
                line, ranks = line_sets(line[mine], place[mine], hashes, order)
                ends = np.cumsum(np.bincount(line, minlength=len(rows))[wanted])
                sets = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(hashes[order][ranks].view(np.int64)))
                wide = wide_bitmaps(hashes[order][ranks], np.concatenate(([0], ends[:-1])).astype(np.int64))
                place = np.cumsum(wanted)[at] - 1
                columns = [asked.field("number"), sets.take(pa.array(place)), *[pa.array(w[place].view(np.int64)) for w in wide]]
                yield pa.RecordBatch.from_arrays(columns, ["number", "tokens", *WIDE_NAMES])

    # Copies of a text give its lines again.
    schema = ", ".join(["number long", "tokens array<long>", *[f"{c} long" for c in WIDE_NAMES]])
    found = texts.select("text", "places").mapInArrow(read, schema)
    return found.groupBy("number").agg(*[F.first(c).alias(c) for c in ("tokens", *WIDE_NAMES)])


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The numbers of the later classes of the pairs (later, earlier) whose sets are similar enough."""
    pairs = stored(pairs.distinct(), "lines-pairs")
    numbers = pairs.select(F.explode(F.array("later", "earlier")).alias("number")).distinct()
    wanted = classes.select("number", "first").join(numbers, "number")
    sets = stored(token_sets(docs, wanted).withColumn("n", F.size("tokens")), "lines-sets")

    def side(own: str, prefix: str, columns: tuple[str, ...]) -> DataFrame:
        return sets.select(F.col("number").alias(own), *[F.col(c).alias(f"{prefix}{c}") for c in columns])

    # Most pairs fall to the wide bitmaps (a lower bound of the difference), which are small beside the sets.
    near = pairs.join(side("later", "x_", ("n", *WIDE_NAMES)), "later").join(side("earlier", "y_", ("n", *WIDE_NAMES)), "earlier")
    apart = reduce(add, [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in WIDE_NAMES])
    near = near.where((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("x_n") + F.col("y_n"))).select("later", "earlier")
    near = stored(near, "lines-near")
    both = side("later", "x_", ("tokens",)).join(checked_broadcast(near), "later").join(side("earlier", "y_", ("tokens",)), "earlier")
    both = both.withColumnsRenamed({"x_tokens": "x", "y_tokens": "y"})
    both = both.select("later", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("sizes") - F.col("common"))).select("later").distinct()


def token_ranges() -> list[Column]:
    """Conditions that part the 32-bit tokens into RANGES ranges."""
    ends = [(1 << 32) * k // RANGES - (1 << 31) for k in range(RANGES + 1)]
    return [F.col("token").between(a, b - 1) for a, b in zip(ends, ends[1:])]


def meetings(lists: DataFrame, settled: DataFrame) -> DataFrame:
    """(later, earlier): classes not settled yet and the earlier classes of their lists that may be similar."""
    mine = [f"x_{c}" for c in ("number", "size", "at", "bitmap", "wide")]
    unsettled = lists.where("asks").join(checked_broadcast(settled), lists["x_number"] == settled["later"], "left_anti").select("token", *mine, "head")
    others = lists.where("answers").select(F.col("token").alias("t"), *[F.col(c).alias(c.replace("x_", "y_")) for c in mine])
    earlier = (F.col("x_number") > F.col("y_number")) & (F.col("y_number") != F.col("head"))
    met = unsettled.join(others, (F.col("token") == F.col("t")) & earlier & may_match("x", "y"))
    return met.select(F.col("x_number").alias("later"), F.col("y_number").alias("earlier"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text) and the sorted numbers of the lines to remove, for documents that have some."""
    lines = stored(split_lines(docs, token_counts(docs)), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line")
    classes = lines.groupBy("class").agg(
        F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("size", "bitmap", "prefix", "salts", "ats", "wide")]
    )
    # Numbers that rise with the first lines, written once.
    order = ["first.no_id", "first.doc_id", "first.key", "first.line"]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    classes = stored(classes, "lines-classes")

    postings = classes.select("number", "size", "bitmap", "wide", F.explode(F.arrays_zip("prefix", "salts", "ats")).alias("posting"))
    postings = postings.select(
        F.col("posting.prefix").alias("token"), F.col("posting.salts").alias("salt"), F.col("number").alias("x_number"),
        F.col("size").alias("x_size"), F.col("posting.ats").alias("x_at"), F.col("bitmap").alias("x_bitmap"), F.col("wide").alias("x_wide"),
    )
    # The running frame holds one row, so a long list streams through.
    in_list = Window.partitionBy("token", "salt").orderBy("x_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("token", "salt").orderBy("x_number")
    heads = {f"y_{c}": F.first(f"x_{c}").over(in_list) for c in ("number", "size", "at", "bitmap", "wide")}
    lists = postings.withColumns({**heads, "place": F.row_number().over(after), "more": F.lead("x_number").over(after).isNotNull()})
    candidate = (F.col("x_number") > F.col("y_number")) & may_match("x", "y")
    # Beyond the first of its list, a class can meet earlier ones from the third place on, and later ones up to the last but
    # one.  The parts of a salted token (its salts start at 1) meet one another, so there all rows ask and answer.
    salted = F.col("salt") > 0
    asks, answers = salted | (F.col("place") > 2), salted | ((F.col("place") > 1) & F.col("more"))
    mine = [f"x_{c}" for c in ("number", "size", "at", "bitmap", "wide")]
    roles = {"candidate": candidate, "asks": asks, "answers": answers}
    lists = lists.select("token", *mine, F.col("y_number").alias("head"), *[c.alias(name) for name, c in roles.items()])
    # Lists are made and joined one range of tokens after another, so that only one range's shuffle is on disk.
    parts = [stored(lists.where("candidate or asks or answers").where(part), "lines-lists") for part in token_ranges()]
    star = reduce(DataFrame.unionByName, parts).where("candidate").select(F.col("x_number").alias("later"), F.col("head").alias("earlier"))
    settled = stored(confirmed(docs, classes, star), "lines-settled")
    met = reduce(DataFrame.unionByName, [stored(meetings(part, settled), "lines-met") for part in parts])
    rest = confirmed(docs, classes, met)
    gone = settled.unionByName(rest).distinct()

    judged = classes.join(gone, classes["number"] == gone["later"], "left").select("class", "first", F.col("later").isNotNull().alias("gone"))
    rows = lines.select("doc_id", "key", "line", "class").join(judged, "class")
    later = F.col("gone") | ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("line") == F.col("first.line")))
    return rows.where(later).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the removed lines; a document that loses its last words goes."""
    removed = removed_lines(docs).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("lines").alias("__lines"))
    rows = docs.withColumn("__own", F.xxhash64("text"))
    rows = rows.join(removed, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("__lines", i)), "\n")
    # The new text is computed once, below the projection that uses it several times.
    rows = rows.withColumn("__kept", F.when(F.col("__lines").isNull(), docs["text"]).otherwise(kept))
    rows = rows.where(F.col("__lines").isNull() | F.col("__kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else rows[c] for c in docs.columns])


def line_digest(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    removed = removed_lines(slim).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "lines")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    rows = slim.select("doc_id", F.xxhash64("text").alias("key"), n_lines.cast("long").alias("n_lines"))
    out = rows.join(removed, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["key"] == F.col("k")), "left")
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("lines", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"),
    )
