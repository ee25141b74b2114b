"""Forests and boosting grown level by level over packed rows, for fits of hundreds of trees.

Rows are packed once, a byte per feature: the part of its column that a value lies in.  A level of a tree is one pass, in which
tasks walk their rows to the open nodes and add up what lies in each part; only these sums leave a task, and no row moves.  The
rules are those of the library's trees: splits of the greatest gain, the first of equal ones, and sibling leaves of one prediction merged.  All
sums are of whole numbers, so they are exact and don't depend on the order or the parts of the rows.  What is returned is the library's own
model, read from its saved form.
"""

from __future__ import annotations

import json
import math
import pickle
import sys
import time
import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, work_dir

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16  # rows packed and added up at a time
SUMMARY = 2048  # values that describe a column of a part
NO_CUT = 255  # no part lies beyond: rows stay in a leaf
MIN_GAIN = 1e-12
DIRECT = 64  # the driver adds up the sums of so many parts, beyond that tasks do
SUMS_BYTES = 64 << 20  # sums that a task holds for a pass of a forest
KEPT_ROUNDS = 10  # rounds of boosting between checkpoints


# --- packed rows -------------------------------------------------------------------


def _chunks(batches):
    """Arrow batches (x, label, weight) as numpy arrays of up to about CHUNK rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield _arrays(held)
            held, n = [], 0
    if held:
        yield _arrays(held)


def _arrays(batches):
    x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches])
    label, weight = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in (1, 2))
    return x, label, weight


def merged(values: np.ndarray, weights: np.ndarray, limit: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights; of more than ``limit`` those at even shares of the weight, each with all since the one before."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    values, weights = values[first], np.add.reduceat(weights, first)
    if len(values) <= limit:
        return values, weights
    upto = np.cumsum(weights)
    kept = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], limit + 1)[1:]).clip(max=len(values) - 1))
    return values[kept], np.diff(upto[kept], prepend=0.0)


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Where a column is cut: between all values if they are few, else into parts of even weight, a frequent value in its own."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    out, rest, held = [], weights.sum(), 0.0
    for value, weight in zip(values[:-1], weights[:-1]):
        held += weight
        if len(out) < bins - 1 and held >= rest / (bins - len(out)):
            out.append(value)
            rest -= held
            held = 0.0
    return np.array(out)


def pack(rows: DataFrame, label: str, bins: int) -> tuple[RDD, list[np.ndarray]]:
    """Blocks {x: a row of bytes per feature, label, weight} of (features, label, weight), and each feature's cuts."""
    plain = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))

    def describe(batches):
        held = None
        for x, _, weight in _chunks(batches):
            now = [merged(x[:, f], weight) for f in range(x.shape[1])]
            held = now if held is None else [merged(*map(np.concatenate, zip(a, b))) for a, b in zip(held, now)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["summary"])

    # A few thousand values a feature and part.
    found = [pickle.loads(r.summary) for r in plain.mapInArrow(describe, "summary binary").collect()]
    cuts = [cut_points(*merged(*map(np.concatenate, zip(*parts)), limit=sys.maxsize), bins) for parts in zip(*found)]

    def cut(batches):
        for x, mark, weight in _chunks(batches):
            packed = np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])
            cells = (packed, mark.astype(np.uint8), weight)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in cells], names=["x", "label", "weight"])

    def unpack(r):
        label = np.frombuffer(r.label, np.uint8)
        return {"x": np.frombuffer(r.x, np.uint8).reshape(-1, len(label)), "label": label, "weight": np.frombuffer(r.weight)}

    blocks = plain.mapInArrow(cut, "x binary, label binary, weight binary").rdd.map(unpack)
    return blocks.persist(StorageLevel.MEMORY_AND_DISK), cuts


# --- growing -----------------------------------------------------------------------


class Tree:
    """Nodes in the order they were made; children stand side by side.  A leaf's ``left`` is itself and its ``cut`` NO_CUT."""

    def __init__(self):
        self.feature, self.cut, self.left, self.gain = np.zeros(1, int), np.full(1, NO_CUT), np.zeros(1, int), np.full(1, -1.0)

    def __len__(self):
        return len(self.left)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The left children's numbers; the right ones follow each."""
        left = len(self) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes], self.gain[nodes] = feature, cut, left, gain
        new = 2 * len(nodes)
        self.left = np.concatenate([self.left, len(self) + np.arange(new)])
        self.feature = np.concatenate([self.feature, np.zeros(new, int)])
        self.cut = np.concatenate([self.cut, np.full(new, NO_CUT)])
        self.gain = np.concatenate([self.gain, np.full(new, -1.0)])
        return left

    def walk(self, x: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row has come to."""
        flat, start = x.reshape(-1), self.feature * x.shape[1]
        node = np.zeros(len(rows), int)
        for _ in range(depth):
            node = self.left[node] + (flat[start[node] + rows] > self.cut[node])
        return node

    def pruned(self, prediction: np.ndarray) -> np.ndarray:
        """Merges sibling leaves of one prediction, also those that arise from it; returns the numbers of the nodes that are left."""
        gone = np.zeros(len(self), bool)
        for node in range(len(self) - 1, -1, -1):
            left = self.left[node]
            if left != node and (self.left[left : left + 2] == (left, left + 1)).all() and prediction[left] == prediction[left + 1]:
                gone[left : left + 2] = True
                self.left[node], self.feature[node], self.cut[node], self.gain[node] = node, 0, NO_CUT, -1.0
        return np.flatnonzero(~gone)


def _added(parts: RDD):
    """The sum of one array (or tuple of arrays) a part."""
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    if parts.getNumPartitions() > DIRECT:
        return parts.treeReduce(add)
    return reduce(add, parts.collect())


# --- boosting ----------------------------------------------------------------------


def _start(scale: float, block: dict) -> dict:
    """The first tree is fitted to the labels, -1 and 1.  Weights and what a tree is fitted to are whole numbers."""
    weight = np.rint(block["weight"] * scale)
    side = 2.0 * block["label"] - 1
    return {"x": block["x"], "side": side, "weight": weight, "margin": np.zeros(len(side)), "pull": weight * side, "tail": None}


def _advance(tree: Tree, depth: int, step: np.ndarray, block: dict) -> dict:
    """After ``tree``, which adds ``step`` at each node: margins, residuals, and the rows and squares of the tree's leaves."""
    leaf = tree.walk(block["x"], np.arange(len(block["side"])), depth)
    squares = np.divide(block["pull"] ** 2, block["weight"], out=np.zeros(len(leaf)), where=block["weight"] > 0)
    tail = np.bincount(leaf, minlength=len(tree)), np.bincount(leaf, squares, len(tree))
    margin = block["margin"] + step[leaf]
    pull = np.rint(block["weight"] * (4 * block["side"] / (1 + np.exp(2 * block["side"] * margin))))
    return block | {"margin": margin, "pull": pull, "tail": tail}


def _tails(blocks):
    tails = [b["tail"] for b in blocks if b["tail"] is not None]
    if tails:
        yield tuple(map(sum, zip(*tails)))


def _level_sums(tree: Tree, depth: int, slots: np.ndarray, n_slots: int, bins: int, blocks):
    """Weights and pulls by feature, open node and part (slot -1: not asked for), and the tail of the tree before."""
    total, tail = 0, []
    for block in blocks:
        x, n = block["x"], len(block["side"])
        rows = np.arange(n)
        if depth:
            slot = slots[tree.walk(x, rows, depth)]
            rows = np.flatnonzero(slot >= 0)
            base = slot[rows] * bins
        else:
            base = np.zeros(n, int)
            if block["tail"] is not None:
                tail.append(block["tail"])
        whole = len(rows) == n
        weight, pull = (block[c] if whole else block[c][rows] for c in ("weight", "pull"))
        at = [base + (column if whole else column[rows]) for column in x]
        total = total + np.array([[np.bincount(a, v, n_slots * bins) for a in at] for v in (weight, pull)])
    if not isinstance(total, int):
        yield total, *(map(sum, zip(*tail)) if tail else (0, 0))


def _best_by_variance(sums: np.ndarray):
    """sums: (2, features, nodes, parts).  Feature, cut, gain, and the weights and pulls of both sides, by node."""
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    left = left[..., :-1]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [s[1] ** 2 / s[0] for s in (left, right, whole)]
        gain = (parts[0] + parts[1] - parts[2]) / whole[0]
    gain = np.where((left[0] > 0) & (right[0] > 0), gain, -np.inf)
    by_node = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    best = by_node.argmax(axis=1)
    feature, cut = np.divmod(best, gain.shape[2])
    node = np.arange(len(best))
    return feature, cut, by_node[node, best], left[:, feature, node, cut], right[:, feature, node, cut]


def boosted_trees(rows: DataFrame, label: str, rounds: int, rate: float, depth: int, bins: int = 32) -> tuple[list[dict], list[float]]:
    """Trees fitted to the residuals of the logistic loss, as nodes, and their weights.

    Margins and residuals are kept with the packed rows between rounds; every few rounds they are checkpointed.  Of two
    sibling nodes the lighter one's sums are taken, the other's are what is left of the parent's.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    blocks, cuts = pack(rows, label, bins)
    total = blocks.map(lambda b: float(b["weight"].sum())).sum()
    # Pulls are at most four times the weights, and their sums stay below 2 ** 52.
    scale = 2.0 ** math.floor(50 - math.log2(max(total, 1.0)))
    state, grown, kept, tail = blocks.map(partial(_start, scale)), [], None, None
    for number in range(rounds):
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if number % KEPT_ROUNDS == KEPT_ROUNDS - 1:
            state.checkpoint()
        tree, nodes, sums = Tree(), np.zeros(1, int), None
        weight, pull = np.zeros(1), np.zeros(1)
        for level in range(depth):
            # The children of a split stand in pairs.
            asked = nodes if sums is None else nodes.reshape(-1, 2)[np.arange(len(nodes) // 2), lighter]
            slots = np.full(len(tree), -1)
            slots[asked] = np.arange(len(asked))
            found, *last = _added(state.mapPartitions(partial(_level_sums, tree, level, slots, len(asked), bins)))
            found = found.reshape(2, len(cuts), len(asked), bins)
            if sums is None:
                sums, tail = found, last
                weight[0], pull[0] = found[:, 0, 0].sum(axis=1)
            else:
                both = np.empty((*found.shape[:2], len(asked), 2, bins))
                pair = np.arange(len(asked))
                both[:, :, pair, lighter], both[:, :, pair, 1 - lighter] = found, sums - found
                sums = both.reshape(2, len(cuts), len(nodes), bins)
            feature, cut, gain, left, right = _best_by_variance(sums)
            split = np.flatnonzero(gain > MIN_GAIN)
            if not len(split):
                break
            first = tree.split(nodes[split], feature[split], cut[split], gain[split])
            weight, pull = (np.concatenate([v, np.stack([left[i, split], right[i, split]], 1).reshape(-1)]) for i, v in enumerate((weight, pull)))
            nodes = np.stack([first, first + 1], 1).reshape(-1)
            sums, lighter = sums[:, :, split], (left[0, split] > right[0, split]).astype(int)
        if grown:
            grown[-1]["tail"] = tail
            before.unpersist()
        if number % KEPT_ROUNDS == KEPT_ROUNDS - 1:
            kept = _replaced(spark, kept, state)
        prediction = np.divide(pull, weight, out=np.zeros(len(tree)), where=weight > 0)
        grown.append({"tree": tree, "weight": weight / scale, "pull": pull / scale})
        before, state = state, state.map(partial(_advance, tree, depth, prediction * (rate if number else 1.0)))
    grown[-1]["tail"] = _added(state.mapPartitions(_tails))
    before.unpersist()
    blocks.unpersist()
    _replaced(spark, kept, None)
    return [_boosting_nodes(g, scale, cuts) for g in grown], [1.0] + [rate] * (rounds - 1)


def _replaced(spark: SparkSession, old: str | None, new: RDD | None) -> str | None:
    """The newest checkpoint's file; the one before is removed."""
    if old:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return new.getCheckpointFile() if new is not None else None


def _boosting_nodes(grown: dict, scale: float, cuts: list[np.ndarray]) -> dict:
    """A row per node, as the library saves them; what only leaves know is added up towards the root."""
    tree, weight, pull = grown["tree"], grown["weight"], grown["pull"]
    count, squares = grown["tail"][0].astype(np.int64), grown["tail"][1] / scale
    for node in range(len(tree) - 1, -1, -1):
        left = tree.left[node]
        if left != node:
            count[node], squares[node] = count[left : left + 2].sum(), squares[left : left + 2].sum()
    prediction = np.divide(pull, weight, out=np.zeros(len(tree)), where=weight > 0)
    spread = np.divide(squares, weight, out=np.zeros(len(tree)), where=weight > 0) - prediction**2
    return _node_columns(tree, tree.pruned(prediction), prediction, np.maximum(spread, 0.0), np.stack([weight, pull, squares], 1), count, cuts)


# --- forest ------------------------------------------------------------------------


def _bag_table() -> np.ndarray:
    """How often a row is in a bag, for each of 65,536 equally likely draws: Poisson with mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def _forest_sums(group: list, depth: int, bins: int, classes: int, seed: int, bagged: bool, part: int, blocks):
    """(tree, counts by open node, its features, their parts and class) of a part's rows."""
    blocks = list(blocks)
    if not blocks:
        return
    x, label = (np.concatenate([b[c] for b in blocks], axis=-1) for c in ("x", "label"))
    table, n = _bag_table(), len(label)
    flat, mark = x.reshape(-1), label.astype(int)
    for number, tree, slots, features in group:
        if bagged:
            draws = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, number, part])).integers(0, 65_536, n, np.uint16)
            times = table[draws]
            rows = np.flatnonzero(times)
        else:
            times, rows = np.ones(n), np.arange(n)
        slot = slots[tree.walk(x, rows, depth)]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        times, tail = times[rows].astype(float), mark[rows]
        size = features.shape[0] * bins * classes
        start = features * n
        sums = [np.bincount((slot * bins + flat[start[:, j][slot] + rows]) * classes + tail, times, size).astype(np.int32) for j in range(features.shape[1])]
        yield number, np.stack(sums).reshape(features.shape[1], len(features), bins, classes)


def _best_by_gini(class_weights: np.ndarray, counts: np.ndarray):
    """counts: (features, nodes, parts, classes).  Place of the feature, cut, gain, and the counts of both sides, by node."""
    left = np.cumsum(counts, axis=2, dtype=np.int64)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left

    def purity(side):
        weighted = side * class_weights
        total = weighted.sum(axis=3)
        return np.divide((weighted**2).sum(axis=3), total, out=np.zeros(total.shape), where=total > 0), total

    (l, wl), (r, wr), (w, total) = map(purity, (left, right, whole))
    gain = np.divide(l + r - w, total, out=np.zeros(l.shape), where=total > 0)
    gain = np.where((wl > 0) & (wr > 0), gain, -np.inf)
    by_node = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    best = by_node.argmax(axis=1)
    place, cut = np.divmod(best, gain.shape[2])
    node = np.arange(len(best))
    return place, cut, by_node[node, best], left[place, node, cut], right[place, node, cut]


def forest_trees(
    rows: DataFrame, label: str, class_weights: list[float], n_trees: int, depth: int, per_node: int | None, seed: int, bins: int = 32, bagged: bool = True
) -> list[dict]:
    """Trees over bags of the rows, ``per_node`` features (None: all) drawn for each node, as nodes.

    All trees grow at the same time, so many in a pass that a task's sums stay bounded; the sums of a tree are added up in one task, which
    finds its splits.  Rows are walked from the root in every pass and bags are drawn anew from the same seeds, so nothing is
    kept for each row and tree.  A row counts with the weight of its class.
    """
    blocks, cuts = pack(rows, label, bins)
    classes, weights = len(class_weights), np.array(class_weights)
    per_node = per_node or len(cuts)
    trees = [Tree() for _ in range(n_trees)]
    counts = [np.zeros((1, classes), np.int64) for _ in trees]
    asked = [np.zeros(1, int) for _ in trees]
    draws = [np.random.default_rng([seed & 0xFFFFFFFF, i]) for i in range(n_trees)]
    most = max(1, SUMS_BYTES // (per_node * bins * classes * 4))
    parts = blocks.getNumPartitions()
    for level in range(depth):
        left_over = [i for i in range(n_trees) if len(asked[i])]
        while left_over:
            group, held = [], 0
            while left_over and (not group or held + len(asked[left_over[-1]]) <= most):
                i = left_over.pop()
                slots = np.full(len(trees[i]), -1)
                slots[asked[i]] = np.arange(len(asked[i]))
                features = np.sort(np.argsort(draws[i].random((len(asked[i]), len(cuts))), axis=1)[:, :per_node], axis=1)
                group.append((i, trees[i], slots, features))
                held += len(asked[i])
            sums = blocks.mapPartitionsWithIndex(partial(_forest_sums, group, level, bins, classes, seed, bagged))
            splits = sums.reduceByKey(np.add, min(parts, len(group))).mapValues(partial(_best_by_gini, weights))
            found = splits.collect()
            splits._jrdd.rdd().cleanShuffleDependencies(False)  # one pass's sums on disk
            features = {i: f for i, _, _, f in group}
            for i, (place, cut, gain, left, right) in found:
                if not level:
                    counts[i][0] = left[0] + right[0]
                split = np.flatnonzero(gain > MIN_GAIN)
                first = trees[i].split(asked[i][split], features[i][split, place[split]], cut[split], gain[split])
                new = np.stack([left[split], right[split]], 1).reshape(-1, classes)
                counts[i] = np.concatenate([counts[i], new])
                asked[i] = np.stack([first, first + 1], 1).reshape(-1)[(new > 0).sum(axis=1) > 1]
    blocks.unpersist()
    return [_forest_nodes(t, c, weights, cuts) for t, c in zip(trees, counts)]


def _forest_nodes(tree: Tree, counts: np.ndarray, class_weights: np.ndarray, cuts: list[np.ndarray]) -> dict:
    stats = counts * class_weights
    prediction = stats.argmax(axis=1).astype(float)
    total = np.maximum(stats.sum(axis=1, keepdims=True), np.finfo(float).tiny)
    impurity = 1 - ((stats / total) ** 2).sum(axis=1)
    return _node_columns(tree, tree.pruned(prediction), prediction, impurity, stats, counts.sum(axis=1), cuts)


# --- the library's models ----------------------------------------------------------

NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
])


def _node_columns(tree: Tree, kept: np.ndarray, prediction, impurity, stats, count, cuts: list[np.ndarray]) -> dict:
    """The kept nodes, numbered anew, parents before children."""
    number = np.full(len(tree), -1)
    number[kept] = np.arange(len(kept))
    leaf = tree.left[kept] == kept
    left = np.where(leaf, -1, number[tree.left[kept]])
    feature = np.where(leaf, -1, tree.feature[kept])
    thresholds = [[] if f < 0 else [float(cuts[f][c])] for f, c in zip(feature, tree.cut[kept])]
    return {
        "prediction": prediction[kept], "impurity": impurity[kept], "stats": stats[kept], "count": count[kept], "gain": tree.gain[kept],
        "left": left, "right": np.where(leaf, -1, left + 1), "feature": feature, "thresholds": thresholds,
    }


def _node_table(trees: list[dict]) -> pa.Table:
    both = {c: np.concatenate([t[c] for t in trees]) for c in ("prediction", "impurity", "count", "gain", "left", "right", "feature")}
    n = [len(t["left"]) for t in trees]
    thresholds = pa.array([v for t in trees for v in t["thresholds"]], pa.list_(pa.float64()))
    stats = np.concatenate([t["stats"] for t in trees])
    offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1])
    real, whole = (lambda c: pa.array(both[c], pa.float64())), (lambda c: pa.array(both[c].astype(np.int32), pa.int32()))
    split = pa.StructArray.from_arrays([whole("feature"), thresholds, pa.array(np.full(sum(n), -1, np.int32))], fields=list(NODE.field("split").type))
    ids = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
    cells = [
        pa.array(ids), real("prediction"), real("impurity"), pa.ListArray.from_arrays(offsets, pa.array(stats.reshape(-1))),
        pa.array(both["count"].astype(np.int64)), real("gain"), whole("left"), whole("right"), split,
    ]
    nodes = pa.StructArray.from_arrays(cells, fields=list(NODE))
    return pa.table({"treeID": pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), "nodeData": nodes})


def _as_model(spark: SparkSession, kind, estimator, trees: list[dict], weights: list[float], n_features: int, **sizes):
    """The library's model of these trees: saved in its form and loaded."""
    path = work_dir(spark, "trees")
    family = "regression.DecisionTreeRegressionModel" if kind is GBTClassificationModel else "classification.DecisionTreeClassificationModel"

    def about(name, params, defaults, **more):
        common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": f"{name.split('.')[-1]}_{uuid.uuid4().hex[:12]}"}
        return json.dumps({"class": f"org.apache.spark.ml.{name}", **common, "paramMap": params, "defaultParamMap": defaults, **more})

    params, defaults = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    model = about(f"classification.{kind.__name__}", params, defaults, numFeatures=n_features, numTrees=len(trees), **sizes)
    spark.createDataFrame([(model,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(_node_table(trees)).write.parquet(f"{path}/data")
    each = [(i, about(family, {"maxDepth": estimator.getMaxDepth()}, {}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return kind.load(path)


def _n_features(rows: DataFrame) -> int:
    return len(rows.first()["features"])


def fit_boosting(estimator: GBTClassifier, rows: DataFrame) -> GBTClassificationModel:
    """What ``estimator`` would fit to (features, label, weight)."""
    trees, weights = boosted_trees(rows, estimator.getLabelCol(), estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getMaxBins())
    return _as_model(rows.sparkSession, GBTClassificationModel, estimator, trees, weights, _n_features(rows))


def fit_forest(estimator: RandomForestClassifier, rows: DataFrame) -> RandomForestClassificationModel:
    """What ``estimator`` would fit to (features, label, weight), with bags and features of other draws; rows of a class have one weight."""
    label, n_trees, n_features = estimator.getLabelCol(), estimator.getNumTrees(), _n_features(rows)
    found = {int(r[0]): r[1] for r in rows.groupBy(label).agg(F.min("weight")).collect()}  # a row per class
    weights = [found.get(c, 0.0) for c in range(max(2, max(found) + 1))]
    per_node = math.ceil(math.sqrt(n_features)) if n_trees > 1 else None
    trees = forest_trees(rows, label, weights, n_trees, estimator.getMaxDepth(), per_node, estimator.getSeed(), estimator.getMaxBins())
    return _as_model(rows.sparkSession, RandomForestClassificationModel, estimator, trees, [1.0] * n_trees, n_features, numClasses=len(weights))
