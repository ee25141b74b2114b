"""Centroid clustering: Lloyd's rounds with the dimensions dealt out in column blocks.

Vectors are cut into chunks of rows and each chunk into blocks of columns.  A task of a column block holds only its slice of
the centroids and gives the exact partial squared distances of a chunk; the partials of a chunk's blocks are added by key and
the nearest centroid taken.  Each block then gets its rows' assignments back and updates its own slice of the centroids.  A chunk's
partials are rows * centroids numbers, so the group of a key is bounded by blocks * that, and what reaches the driver is
centroids * dimensions sums.  Chunks, assignments and nothing else are written between the steps.

Defined results: rows are left out whose vector is NULL, has another number of components, or NULL, NaN or infinite ones.
Components are held within plus or minus 2**26 after scaling, so that a distance fits a long; an inertia beyond a long is the
largest long.  Ties go to the smaller centroid; equal starting hashes (repeated ids) are ordered by vector; a NULL id is
hashed as an empty one.  With fewer vectors than centroids each vector starts one, and an empty table gives no rows.  Repeated
rows give a row each; other columns of the vectors are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import stored
from tillwatch.llm.vectors import finite_rows, is_finite, scaled

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LIMIT = 2**26
#: Columns of a block, rows of a chunk, and tasks that the chunks of a block are dealt to at most.
BLOCK = 16
CHUNK = 4096
DEALS = 4096


def column_blocks(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """chunk, block, ids (in the first block only) and data, the block's integers of the chunk's rows."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, matrix in finite_rows(batch.column(1)):
                if matrix.shape[1] != dimensions:
                    continue
                x = scaled(matrix, scale, LIMIT).astype("<i4")
                for i in range(0, len(rows), CHUNK):
                    ids = batch.column(0).take(pa.array(rows[i : i + CHUNK]))
                    parts = [np.ascontiguousarray(x[i : i + CHUNK, j : j + BLOCK]).tobytes() for j in range(0, dimensions, BLOCK)]
                    n = len(parts)
                    offsets = pa.array([0] + [len(ids)] * n, pa.int32())
                    columns = [pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32())]
                    columns += [pa.ListArray.from_arrays(offsets, ids), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "block", "ids", "data"])
                    chunk += 1

    blocks = vectors.select("vec_id", column).mapInArrow(cut, f"chunk long, block int, ids array<{kind}>, data binary")
    return blocks.repartition("block", F.pmod(F.xxhash64("chunk"), F.lit(DEALS)))


def first_centroids(vectors: DataFrame, column: str, dimensions: int, scale: int, count: int, seed: int) -> np.ndarray:
    """The `count` vectors of the smallest hashes, in their order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    kept = vectors.where((F.size(column) == dimensions) & is_finite(column)).select(F.sha2(named, 256).alias("hash"), column)
    rows = kept.orderBy("hash", column).limit(count).collect()
    return np.array([scaled(np.array(r[column], dtype=np.float64), scale, LIMIT) for r in rows], dtype=np.int64).reshape(-1, dimensions)


def slices(column, width: int) -> Iterator[np.ndarray]:
    for data in column.to_pylist():
        yield np.frombuffer(data, dtype="<i4").astype(np.int64).reshape(-1, width)


def width_of(block: int, dimensions: int) -> int:
    return min(BLOCK, dimensions - block * BLOCK)


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows * centroids) of integer vectors of one column block."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if most * most * x.shape[1] < 2**52:
        inner = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        inner = x @ centroids.T
    return (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * inner


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """chunk, nearest (a 32-bit number per row) and distance (a long per row), in the rows' order."""
    dimensions = centroids.shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast([centroids[:, j : j + BLOCK] for j in range(0, dimensions, BLOCK)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column(1).to_pylist()):
                x = next(slices(batch.column(2).slice(i, 1), width_of(block, dimensions)))
                part = partial_distances(x, shared.value[block])
                part = part.astype("<u4" if part.max() < 2**32 else "<i8")
                columns = [batch.column(0).slice(i, 1), pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "width", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = 0
        for width, part in zip(parts["width"].to_pylist(), parts["part"].to_pylist()):
            total = total + np.frombuffer(part, dtype="<u4" if width == 4 else "<i8").astype(np.int64)
        total = total.reshape(-1, len(centroids))
        nearest = total.argmin(axis=1)
        best = total[np.arange(len(total)), nearest]
        columns = {"chunk": parts["chunk"][:1], "nearest": [nearest.astype("<i4").tobytes()], "distance": [best.astype("<i8").tobytes()]}
        return pa.table(columns, schema=pa.schema([("chunk", pa.int64()), ("nearest", pa.binary()), ("distance", pa.binary())]))

    parts = blocks.select("chunk", "block", "data").mapInArrow(measure, "chunk long, width int, part binary")
    return parts.groupBy("chunk").applyInArrow(add, "chunk long, nearest binary, distance binary")


def moved(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after every block has updated its slice; empty ones stay."""
    count, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        sizes: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                width = width_of(block, dimensions)
                x = next(slices(batch.column(1).slice(i, 1), width))
                nearest = np.frombuffer(batch.column(2)[i].as_py(), dtype="<i4")
                own = sums.setdefault(block, np.zeros((count, width), dtype=np.int64))
                np.add.at(own, nearest, x)
                sizes[block] = sizes.get(block, 0) + np.bincount(nearest, minlength=count)
        for block, own in sums.items():
            used = np.flatnonzero(sizes[block])
            columns = [pa.array([block] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(sizes[block][used], pa.int64())]
            columns.append(pa.array(own[used].tolist(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["block", "cluster", "size", "sums"])

    rows = blocks.join(assigned.select("chunk", "nearest"), "chunk").select("block", "data", "nearest")
    parts = rows.mapInArrow(add, "block int, cluster int, size long, sums array<long>")
    parts = parts.select("block", "cluster", "size", F.posexplode("sums").alias("at", "sum"))
    parts = parts.groupBy("block", "cluster", "at").agg(F.sum("size").alias("size"), F.sum("sum").alias("sum"))
    out = centroids.copy()
    # A row for each centroid and dimension.
    for r in parts.collect():
        out[r["cluster"], r["block"] * BLOCK + r["at"]] = r["sum"] // r["size"]
    return out


def cluster(
    vectors: DataFrame,
    column: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every kept vector, and the final centroids."""
    centroids = first_centroids(vectors, column, dimensions, scale, count, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    blocks = stored(column_blocks(vectors, column, dimensions, scale), "centroid-blocks")
    for _ in range(rounds):
        centroids = moved(blocks, stored(assign(blocks, centroids), "centroid-rows"), centroids)
    assigned = stored(assign(blocks, centroids), "centroid-rows")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nearest = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i4")
                distance = np.frombuffer(batch.column(2)[i].as_py(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(nearest), pa.array(distance)], ["vec_id", "cluster", "distance"])

    ids = blocks.where("block = 0").select("chunk", "ids")
    rows = ids.join(assigned, "chunk").select("ids", "nearest", "distance")
    return rows.mapInArrow(spread, f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the row's centroid."""
    found, centroids = cluster(vectors)
    rows = stored(found, "centroid-found")
    # A row for each centroid.
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("sum"))
    sums = {r["cluster"]: int(r["sum"]) for r in sums.collect()}
    total = sum(sums.values())
    facts = [
        (c, min(s, 2**63 - 1), min(total, 2**63 - 1), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sums.items()
    ]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
