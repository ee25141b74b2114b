"""Benchmark decontamination: a broadcast set of normalised test windows, looked up in every training text.

The windows of the benchmark are hashed; a document's rolling window hashes are looked up in the sorted set and every
match is confirmed on the words themselves.  Equal texts of the benchmark are taken once, very long ones in pieces, and the
pieces are dealt into blocks of about ``BLOCK_WORDS`` words, so what is collected and broadcast has a bound (twice that);
more blocks mean more passes over the documents, without a shuffle.

Defined results: a NULL or wordless text has no words and no hits; an item without words, or NULL, has no window; an item
without an id marks words but is not listed; repeated items count once, repeated documents give a row each; a very long document takes time in proportion to its length;
an empty benchmark hits nothing; the columns of the documents are kept as they are, and the columns added carry the
``prefix``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import WordHashes, byte_texts, rolling, stored

WINDOW = 10
#: Words (and names of items) of a block; a window takes 12 bytes and its word's own, in the driver and in every worker.
BLOCK_WORDS = 3_000_000
#: Items that one piece names at most, the deals that a text's items are numbered in, and those that pieces are placed in.
ITEMS, ITEM_DEALS, DEALS = 100_000, 16, 512
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class WindowSet:
    """The windows of some pieces of items: sorted hashes by length for the lookup, the words for the confirmation.

    Words stand once, as bytes; a window is its hash and the number of its first word.
    """

    def __init__(self, pieces: list[tuple[list[str], bytes]], window: int):
        known = WordHashes()
        self.owners = [tuple(items) for items, _ in pieces]
        texts, lengths, piece_ends, found = [], [], [], {}
        total = 0
        for _, text in pieces:
            words = words_of(text)
            size = min(window, len(words))
            if size:
                grams = rolling(known.of(words), size)
                found.setdefault(size, []).append((grams, np.arange(total, total + len(grams), dtype=np.int32)))
            texts.append(b"".join(words))
            lengths.append(np.fromiter(map(len, words), dtype=np.int32, count=len(words)))
            total += len(words)
            piece_ends.append(total)
        self.words = b"".join(texts)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths or [np.empty(0, np.int64)]))]).astype(np.int64)
        self.piece_ends = np.array(piece_ends, dtype=np.int64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            hashes, places = (np.concatenate(column) for column in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], places[order]

    def search(self, words: list[bytes], known: WordHashes) -> tuple[list[tuple[int, int]], set[str]]:
        """The windows that occur, as word spans, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        codes = known.of(words)
        for size, (hashes, places) in self.windows.items():
            grams = rolling(codes, size)
            first, last = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            seen: set[int] = set()  # windows that come again in this text name the same items
            for i in np.flatnonzero(last > first).tolist():
                text = b"".join(words[i : i + size])
                hit = False
                for at in places[first[i] : last[i]].tolist():
                    if at in seen:
                        hit = True
                    elif self._is(at, size, text, words[i : i + size]):
                        hit = True
                        seen.add(at)
                        items.update(self.owners[int(np.searchsorted(self.piece_ends, at, "right"))])
                if hit:
                    spans.append((i, i + size))
        return spans, items

    def _is(self, at: int, size: int, text: bytes, words: list[bytes]) -> bool:
        bounds = self.starts[at : at + size + 1]
        return self.words[bounds[0] : bounds[-1]] == text and np.diff(bounds).tolist() == list(map(len, words))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def pieces_of(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """items, text and number of words of the benchmark's distinct texts, each cut into pieces of at most ``block_words``.

    Pieces of a text overlap by a window less a word, so every window stands in one; a text of very many items comes once
    for every ``ITEMS`` of them.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull()).distinct()
    turn = F.row_number().over(Window.partitionBy("text", F.pmod(F.xxhash64("item"), F.lit(ITEM_DEALS))).orderBy("item"))
    items = items.withColumns({"deal": F.pmod(F.xxhash64("item"), F.lit(ITEM_DEALS)), "turn": F.floor((turn - 1) / ITEMS)})
    # A NULL item marks words and isn't listed.
    texts = items.groupBy("text", "deal", "turn").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, names in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                places = [m.span() for m in WORD.finditer(text.lower())]
                step = max(block_words - window + 1, 1)
                for i in range(0, max(len(places) - window + 1, 1) if places else 0, step):
                    part = places[i : i + step + window - 1]
                    columns = [pa.array([names], pa.list_(pa.string())), pa.array([text[part[0][0] : part[-1][1]]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([len(part)], pa.int64())], ["items", "text", "n"])

    return texts.select("text", "items").mapInArrow(cut, "items array<string>, text binary, n long")


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[list[str], bytes]]]:
    """The pieces in blocks of at most ``block_words`` words; a block at a time comes to the driver."""
    pieces = stored(pieces_of(benchmark, window, block_words), "benchmark-pieces")
    # A block takes pieces in the order of a hash until it is full: prefix sums in two steps, over ranges of the hash.
    dealt = pieces.withColumns({"mark": F.xxhash64("text", "items"), "size": F.col("n") + F.size("items")})
    dealt = dealt.withColumn("deal", F.pmod(F.col("mark"), F.lit(DEALS)))
    totals = dealt.groupBy("deal").agg(F.sum("size").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("deal")) - F.col("size"))
    inside = F.sum("size").over(Window.partitionBy("deal").orderBy("mark", "text").rowsBetween(Window.unboundedPreceding, -1))
    # At most DEALS rows.
    placed = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(totals.select("deal", "before")), "deal")
    placed = placed.withColumn("block", F.floor((F.col("before") + F.col("inside")) / block_words))
    placed = stored(placed.select("block", "items", "text"), "benchmark-blocks")
    last = placed.agg(F.max("block").alias("n")).first()["n"]
    for block in range(0 if last is None else last + 1):
        yield [(r["items"], bytes(r["text"])) for r in placed.where(F.col("block") == block).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, prefix: str = "leak_") -> DataFrame:
    """`docs` with n_words, the merged hit spans (in words) and the items found, each under `prefix`."""
    spark = docs.sparkSession
    spans_name, items_name, words_name = f"{prefix}spans", f"{prefix}items", f"{prefix}n_words"
    out = docs.withColumns(
        {
            words_name: F.lit(0).cast("long"),
            spans_name: F.array().cast("array<array<int>>"),
            items_name: F.array().cast("array<string>"),
        }
    )
    schema = out.schema
    blocks = blocks_of(benchmark, window, BLOCK_WORDS)
    # Without a window to look for, one pass still counts the words.
    for pieces in chain([next(blocks, [])], blocks):
        wanted = spark.sparkContext.broadcast(WindowSet(pieces, window))

        def scan(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                names = batch.schema.names
                counts, spans, found = [], [], []
                before = zip(batch.column(names.index(spans_name)).to_pylist(), batch.column(names.index(items_name)).to_pylist())
                for text, (old_spans, old_items) in zip(byte_texts(batch.column(names.index("text"))), before):
                    words = words_of(text)
                    new_spans, new_items = wanted.value.search(words, known) if words else ([], set())
                    counts.append(len(words))
                    spans.append([list(s) for s in merged(new_spans + [tuple(s) for s in old_spans])])
                    found.append(sorted(new_items.union(old_items)))
                columns = {
                    words_name: pa.array(counts, pa.int64()),
                    spans_name: pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    items_name: pa.array(found, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(names, batch.columns)], names)

        out = out.mapInArrow(scan, schema)
    return out


def n_hit(prefix: str = "leak_"):
    return F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    found = find_leaks(docs, benchmark, window, "__leak_")
    return found.where(F.size("__leak_spans") == 0).select(*[found[c] for c in docs.columns])


def cut_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, with the hit word spans (and what stands between their words) cut out of the text."""
    found = find_leaks(docs, benchmark, window, "__leak_")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = []
            for text, spans in zip(byte_texts(batch.column(names.index("text"))), batch.column(names.index("__leak_spans")).to_pylist()):
                if spans:
                    places = [m.span() for m in WORD.finditer(text.lower())]
                    kept, last = [], 0
                    for start, end in spans:
                        kept.append(text[last : places[start][0]])
                        last = places[end - 1][1]
                    text = b"".join([*kept, text[last:]])
                texts.append(None if text is None else text.decode())
            columns = {"text": pa.array(texts, batch.schema.field("text").type)}
            keep = [n for n in names if not n.startswith("__leak_")]
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(names.index(n))) for n in keep], keep)

    return found.mapInArrow(cut, schema)


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    found = find_leaks(slim, benchmark)
    return found.select(
        "doc_id",
        F.col("leak_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (F.size("leak_spans") > 0).alias("contaminated"),
    )
