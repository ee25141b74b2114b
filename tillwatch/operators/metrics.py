"""Evaluation tables over scored rows (label 0/1, score in [0, 1]).

Curves need running counts over all scores in order.  Rows are first tallied per
distinct score (combined map-side).  Scores are then cut into order-preserving
lanes; the totals per lane are few (``LANES`` at most) and are accumulated alone, and
each lane only adds its own running counts to what the lanes above it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LANES = 60_001
POINTS = ["pos", "neg", "scores"]


def _lane(score: Column) -> Column:
    """A non-decreasing lane number that also spreads scores crowded near 0 and 1."""
    logit = F.ln(score / (F.lit(1.0) - score))
    inner = F.greatest(F.lit(-29_999), F.least(F.lit(29_999), F.floor(logit * 1000)))
    return (
        F.when(score <= 0, F.lit(-30_000)).when(score >= 1, F.lit(30_000)).otherwise(inner)
    ).cast("int")


def score_points(scored: DataFrame, label: str = "label", score: str = "score", by: tuple = ()) -> DataFrame:
    """Per distinct score: true and false positives at ``score >= threshold``.

    Columns: the keys ``by``, threshold, pos, neg (at this score), tp, fp, rank (how many
    distinct scores are >= this one), and the totals p, n, scores.
    """
    tally = (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(
            F.count_if(F.col(label).cast("int") == 1).alias("pos"),
            F.count_if(F.col(label).cast("int") == 0).alias("neg"),
        )
        .withColumn("lane", _lane(F.col("threshold")))
    )
    lanes = tally.groupBy(*by, "lane").agg(
        F.sum("pos").alias("lane_pos"),
        F.sum("neg").alias("lane_neg"),
        F.count(F.lit(1)).alias("lane_scores"),
    )
    group = [*by] if by else [F.lit(0)]
    above = (
        Window.partitionBy(*group).orderBy(F.desc("lane")).rowsBetween(Window.unboundedPreceding, -1)
    )
    everything = Window.partitionBy(*group)
    carried = lanes.select(
        *by,
        "lane",
        *[
            F.coalesce(F.sum(f"lane_{c}").over(above), F.lit(0)).alias(f"above_{c}")
            for c in POINTS
        ],
        F.sum("lane_pos").over(everything).alias("p"),
        F.sum("lane_neg").over(everything).alias("n"),
        F.sum("lane_scores").over(everything).alias("scores"),
    )
    inside = (
        Window.partitionBy(*by, "lane")
        .orderBy(F.desc("threshold"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # ``carried`` has at most LANES rows per key, whatever the data.
    joined = tally.join(F.broadcast(carried), [*by, "lane"])
    return joined.select(
        *by,
        "threshold",
        "pos",
        "neg",
        (F.col("above_pos") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("above_neg") + F.sum("neg").over(inside)).alias("fp"),
        (F.col("above_scores") + F.count(F.lit(1)).over(inside)).alias("rank"),
        "p",
        "n",
        "scores",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def roc_curve(points: DataFrame, by: tuple = ()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the curve starts at (0, 0)."""
    return points.select(
        *by,
        "threshold",
        _ratio(F.col("fp"), F.col("n")).alias("fpr"),
        _ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )


def ranking_scores(points: DataFrame, by: tuple = ()) -> DataFrame:
    """ROC-AUC (trapezoids, so ties count half) and step-wise average precision."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n = F.max("p"), F.max("n")
    return points.groupBy(*by).agg(
        F.when((p > 0) & (n > 0), area / (p.cast("double") * n)).alias("roc_auc"),
        _ratio(steps, p).alias("pr_auc"),
    )


def pr_curve(points: DataFrame, by: tuple = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    return points.select(
        *by,
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
    )


def threshold_table(points: DataFrame) -> DataFrame:
    """The precision-recall table with its terminal row (1.0, 1, 0), and ``position``:
    the row's place in ascending threshold order, the terminal row last."""
    body = points.select(
        (F.col("scores") - F.col("rank")).alias("position"),
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
    )
    last = points.agg(F.coalesce(F.max("scores"), F.lit(0)).alias("position")).select(
        "position",
        F.lit(1.0).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return body.unionByName(last)


def sampled_rows(points: DataFrame, pieces: int = 10) -> DataFrame:
    """Every max(1, n // pieces)-th row of the threshold table."""
    step = F.greatest(F.lit(1), F.floor((F.col("scores") + 1) / F.lit(pieces)))
    body = points.select(
        (F.col("scores") - F.col("rank")).alias("position"),
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
        step.alias("step"),
    )
    last = points.agg(F.max("scores").alias("scores")).select(
        F.col("scores").alias("position"),
        F.lit(1.0).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        step.alias("step"),
    )
    rows = body.unionByName(last)
    return rows.where(F.col("position") % F.col("step") == 0).drop("step")


def predicted(score: Column, threshold: float = 0.5) -> Column:
    """A tie at the threshold stays with the negative class."""
    return (score > threshold).cast("int")


def confusion_counts(df: DataFrame, actual: Column, guess: Column) -> DataFrame:
    """(actual, predicted, n): one small table for any number of classes."""
    return (
        df.select(actual.alias("actual"), guess.alias("predicted"))
        .groupBy("actual", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(counts: DataFrame, classes: list) -> DataFrame:
    """One row per actual class, one column per predicted class, zeros filled."""
    wide = counts.groupBy("actual").pivot("predicted", classes).agg(F.sum("n"))
    return wide.fillna(0).select("actual", *[F.col(str(c)).alias(f"predicted_{c}") for c in classes])


def classification_report(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support per class, accuracy, macro and weighted means.

    Works on the confusion counts, so everything after the first count is tiny.
    Undefined ratios are 0.
    """
    cells = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").cast("string").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("claimed"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                    .otherwise(F.lit(0))
                    .alias("right"),
                ),
                F.struct(
                    F.col("predicted").cast("string").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("claimed"),
                    F.lit(0).cast("long").alias("right"),
                ),
            )
        )
    )
    per_class = (
        cells.groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("right").alias("right"))
        .select(
            "class",
            _ratio(F.col("right"), F.col("claimed")).alias("precision"),
            _ratio(F.col("right"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("right"), F.col("claimed") + F.col("support")).alias("f1"),
            "support",
            "right",
        )
    )
    total = F.sum("support")
    accuracy = _ratio(F.sum("right"), total)

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    def line(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support")
        )

    summary = per_class.agg(
        F.array(
            line("accuracy", accuracy, accuracy, accuracy),
            line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("lines")
    ).select(F.inline("lines"))
    return per_class.drop("right").unionByName(summary)


def best_model(scores: DataFrame, by: str = "pr_auc") -> DataFrame:
    """The model with the best ranking score; ties go to the first name."""
    return scores.orderBy(F.desc(by), "model").limit(1)
