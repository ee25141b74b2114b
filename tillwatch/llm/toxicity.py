"""Toxicity by compression distance, with one zstandard dictionary for toxic and one for ordinary text.

Texts are cut into windows of ``WINDOW`` words.  A word is written as a 16-byte hash code (word-based compression) of the
longest *unit* it begins with, a unit being a word or a word's beginning that one of the dictionaries holds, or of itself;
so a window shortens only by units found in a dictionary, and not by the accidents of letter statistics.  Training and
scoring take the words from one function: lower-cased by Unicode, cut at punctuation, symbols and blanks of any script;
a run in a script without word spaces gives its overlapping pairs of characters.  A dictionary is
the codes of the units that are usual in both classes, and of those whose document frequency speaks for its own.  A window's
distance is its length compressed with the ordinary dictionary less its length with the toxic one.  A document has two
figures, the largest distance and the mean of the positive ones; a logistic curve over both is fitted to the labelled
sample, and shifted so that the threshold that separates the sample best has the score ``DECISION``.

Only labelled rows outside the held-out fold are learned from: at most ``SAMPLE`` documents per class, the first by a
hash of their id; texts of the same units count once per class.  The model is a few kilobytes; documents are scored where
they lie, without a shuffle.

Defined results: a NULL or wordless text has distance 0 and so a low score; a very long text is scored window by window; equally
telling units go by length, then by themselves; an empty table gives no rows; labels without an id or a mark are left out,
and of several labels of an id the largest counts; without toxic or without ordinary labels every score is 0; repeated
rows give a row each; documents without an id are not held out (the remainder is NULL) and never learned from; other
columns are kept, and the columns added carry the ``prefix``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import byte_texts, stored

SAMPLE = 4000
WINDOW = 24
DICTIONARY_UNITS = 256
COMMON_UNITS = 16
MIN_STEM, MAX_STEM = 4, 8
#: A class's own unit is in this share of its documents, and so many times more often than in the other's.
MIN_SHARE = 0.03
MIN_RATIO = 8.0
#: Its count times the logarithm of that ratio; less can be chance among the many units of a small sample.
MIN_EVIDENCE = 25.0
LEVEL = 3
DECISION = 0.7
RIDGE = 1e-4
#: Scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED_RANGES = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: No part of a word beyond ASCII: punctuation, symbols, blanks and controls, by ranges.
BREAKS = "".join(re.escape(c) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) == "Cc")
BREAKS += "\u200b\ufeff\U0001f000-\U0001faff"
WORD = re.compile(f"(?:(?=[{UNSPACED_RANGES}])[^\\x00-\\x7f{BREAKS}])+|(?:(?![{UNSPACED_RANGES}])[^\\x00-`{{-\\x7f{BREAKS}])+")
ASCII_WORD = re.compile("[a-z]+")
UNSPACED = re.compile(f"[{UNSPACED_RANGES}]")
#: The compressor starts no match in the last bytes of a window.
PADDING = b"\0" * 8


def words_of(text: bytes | None) -> list[str]:
    if not text:
        return []
    lowered = text.decode("utf-8", "replace").lower()
    if lowered.isascii():
        return ASCII_WORD.findall(lowered)
    out = []
    for word in WORD.findall(lowered):
        if len(word) > 2 and UNSPACED.match(word):
            out += [word[i : i + 2] for i in range(len(word) - 1)]
        else:
            out.append(word)
    return out


@dataclass(frozen=True)
class Model:
    toxic: tuple[str, ...]
    ordinary: tuple[str, ...]
    #: The logistic curve: intercept, weight of the largest distance, weight of the mean; None if not fitted.
    curve: tuple[float, float, float] | None = None


class Codes(dict):
    """word -> the code of its longest unit, remembered up to a bound."""

    LIMIT = 200_000

    def __init__(self, units: tuple[str, ...]):
        super().__init__()
        self.units = frozenset(units)
        self.lengths = sorted({len(u) for u in units}, reverse=True)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        unit = next((word[:n] for n in self.lengths if word[:n] in self.units), word)
        code = self[word] = xxhash.xxh3_128_digest(unit.encode())
        return code


class Compressors:
    """The two compressors of a model; built once per task."""

    def __init__(self, model: Model):
        self.codes = Codes(model.ordinary + model.toxic)
        self.ordinary = self._compressor(model.ordinary)
        self.toxic = self._compressor(model.toxic)

    def _compressor(self, units: tuple[str, ...]) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not units:
            return zstandard.ZstdCompressor(level=LEVEL, **plain)
        content = b"".join(xxhash.xxh3_128_digest(u.encode()) for u in units)
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, **plain)

    def measure(self, text: bytes | None) -> tuple[int, float]:
        """The largest distance of a window, and the mean of the positive ones over all windows."""
        words = words_of(text)
        most = total = 0
        for i in range(0, len(words), WINDOW):
            window = b"".join(map(self.codes.__getitem__, words[i : i + WINDOW])) + PADDING
            distance = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            if distance > 0:
                most, total = max(most, distance), total + distance
        return most, total * WINDOW / max(len(words), WINDOW)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of at most `sample` labelled ids per class outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda c: usable.where((F.col("toxic") > 0) == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(True).unionByName(first(False)).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("__toxic"))
    # At most 2 * sample rows of an id and a mark.
    found = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id"))
    return found.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.col("__toxic").alias("toxic"))


def units_of(text: bytes | None) -> list[str]:
    """The distinct words of a text and their beginnings of MIN_STEM to MAX_STEM letters."""
    words = dict.fromkeys(words_of(text))
    stems = (w[:n] for w in words for n in range(MIN_STEM, min(len(w) - 1, MAX_STEM) + 1))
    return list(words | dict.fromkeys(stems))


def with_units(sample: DataFrame) -> DataFrame:
    """doc_id, toxic and the units of the sample's texts."""
    kind = sample.schema["doc_id"].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([units_of(t) for t in byte_texts(batch.column(2))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "toxic", "units"])

    return sample.select("doc_id", "toxic", "text").mapInArrow(units, f"doc_id {kind}, toxic boolean, units array<string>")


def dictionaries(sample: DataFrame, size: int = DICTIONARY_UNITS) -> tuple[list[str], list[str]]:
    """The units of the toxic and of the ordinary dictionary."""
    rows = with_units(sample).where(F.size("units") > 0)
    rows = stored(rows.select("toxic", "units").distinct(), "toxic-sample")
    # Two rows at most.
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return [], []
    counts = rows.select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(
        F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("ordinary")
    )
    counts = stored(counts.where((F.col("toxic") >= MIN_SHARE * n[True]) | (F.col("ordinary") >= MIN_SHARE * n[False])), "toxic-units")

    def best(own: str, other: str) -> list[str]:
        here, there = n[own == "toxic"], n[other == "toxic"]
        odds = ((F.col(own) + 0.5) / (here + 1)) / ((F.col(other) + 0.5) / (there + 1))
        speaks = F.round(F.col(own) * F.log(odds), 6)
        enough = (F.col(own) >= MIN_SHARE * here) & (odds >= MIN_RATIO) & (speaks >= MIN_EVIDENCE)
        top = counts.where(enough).orderBy(speaks.desc(), F.length("unit").desc(), "unit").limit(8 * size)
        chosen: list[str] = []
        for row in top.select("unit").collect():
            unit = row["unit"]
            if len(chosen) < size and not any(unit.startswith(c) or c.startswith(unit) for c in chosen):
                chosen.append(unit)
        return chosen

    # Units as usual in one class as in the other stand in both dictionaries.
    both = F.least(F.col("toxic") / n[True], F.col("ordinary") / n[False])
    shared = counts.where(both >= MIN_SHARE).orderBy(both.desc(), "unit").limit(COMMON_UNITS)
    common = [r["unit"] for r in shared.collect()]
    toxic, ordinary = best("toxic", "ordinary"), best("ordinary", "toxic")
    return (common + toxic, common + ordinary) if toxic else ([], [])


def measures(docs: DataFrame, model: Model, prefix: str) -> DataFrame:
    """`docs` with the two figures of each text, most and mean, under `prefix`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most, mean = f"{prefix}most", f"{prefix}mean"
    out = docs.withColumns({most: F.lit(0).cast("int"), mean: F.lit(0.0)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(shared.value)
        for batch in batches:
            names = batch.schema.names
            found = [tools.measure(t) for t in byte_texts(batch.column(names.index("text")))]
            columns = {most: pa.array([f[0] for f in found], pa.int32()), mean: pa.array([f[1] for f in found], pa.float64())}
            yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(names, batch.columns)], names)

    return out.mapInArrow(measure, out.schema)


def fit_curve(rows: list[tuple[int, float, int, int]]) -> tuple[float, float, float] | None:
    """rows: (most, mean, toxic, ordinary) -> a logistic curve whose value at the best threshold is DECISION."""
    x = np.array([(1.0, r[0], r[1]) for r in rows])
    toxic, ordinary = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    if not toxic.sum() or not ordinary.sum():
        return None
    toxic, ordinary = toxic / toxic.sum(), ordinary / ordinary.sum()
    weights = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (toxic - p * (toxic + ordinary)) - RIDGE * weights
        bend = (x * ((toxic + ordinary) * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3)
        step = np.linalg.solve(bend, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    height = x @ weights
    best, at, caught, wrong = 0.0, None, 0.0, 0.0
    order = np.argsort(-height, kind="stable")
    for i, here in enumerate(order):
        caught, wrong = caught + toxic[here], wrong + ordinary[here]
        following = height[order[i + 1]] if i + 1 < len(order) else height[here] - 2.0
        if following < height[here] and caught - wrong > best + 1e-12:
            best, at = caught - wrong, (height[here] + following) / 2
    if at is None:
        return None
    shift = math.log(DECISION / (1 - DECISION)) - at
    return float(weights[0] + shift), float(weights[1]), float(weights[2])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = stored(labelled_sample(docs, labels, sample), "toxic-labelled")
    toxic, ordinary = dictionaries(rows)
    model = Model(tuple(toxic), tuple(ordinary))
    if not toxic:
        return model
    # At most a row per sampled document.
    counts = measures(rows, model, "").groupBy("most", F.round("mean", 3).alias("mean"))
    counts = counts.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("ordinary")).orderBy("most", "mean")
    return Model(model.toxic, model.ordinary, fit_curve([tuple(r) for r in counts.collect()]))


def score_column(model: Model, prefix: str) -> Column:
    if model.curve is None:
        return F.lit(0.0)
    base, by_most, by_mean = model.curve
    height = F.lit(base) + F.col(f"{prefix}most") * by_most + F.round(f"{prefix}mean", 3) * by_mean
    return F.round(1 / (1 + F.exp(-height)), 9)


def judge(docs: DataFrame, model: Model, prefix: str = "toxic_") -> DataFrame:
    """`docs` with most, mean, score and predicted (1 from a score of DECISION on) under `prefix`."""
    out = measures(docs, model, prefix)
    out = out.withColumn(f"{prefix}score", score_column(model, prefix))
    return out.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= DECISION).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    out = judge(docs, model, "__toxic_")
    return out.where(F.col("__toxic_predicted") == 0).select(*[out[c] for c in docs.columns])


def toxic_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    out = judge(slim, train(slim, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )
