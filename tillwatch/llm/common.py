"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.session import work_dir

#: Word classes as Java and Python patterns understand them.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
FOLDED_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: one evaluation, and no lineage to lose with an executor.

    The shuffles behind the written table are not read again, so Spark is told to drop them with the query; that keeps
    the disk to one step's shuffles.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, breaks: str) -> Column:
    """The non-empty pieces of a text between runs of break characters."""
    pieces = F.split(text, breaks)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_remove(pieces, ""))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every run of `size` word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * MULTIPLIER + hashes[i : i + n]
    return mixed(out)


def byte_texts(column) -> list[bytes | None]:
    """An Arrow string column as bytes objects."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: A side of a join is broadcast up to so many rows of a few numbers; beyond, Spark plans the join.
BROADCAST_ROWS = 2_000_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count of the (stored) rows."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node reachable (`root`) from undirected edges (a, b).

    Each round takes the smallest root among the neighbours and then the root's own root, so the rounds grow with the
    logarithm of a chain's length; a star takes two.  Every round is written, and the loop ends when nothing changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = stored(step, "roots")
        up = step.select(F.col("node").alias("n"), F.col("root").alias("up"))
        step = step.join(up, step["root"] == F.col("n")).select("node", "old", F.least("root", "up").alias("root"))
        step = stored(step, "roots")
        changed = not step.where(F.col("old") != F.col("root")).isEmpty()
        roots = step.select("node", "root")
        if not changed:
            return roots
