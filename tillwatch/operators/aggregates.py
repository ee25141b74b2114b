"""Grouped and global aggregates over the ledger and the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ledger import latest

from .quantiles import exact_quantiles


def monitoring_kpis(events: DataFrame, n: int = 30) -> DataFrame:
    """Figures over the newest ``n`` events (id, created_at, is_fraud, amount)."""
    window = latest(events.select("id", "created_at", "is_fraud", "amount"), n)
    flagged = F.count_if(F.col("is_fraud"))
    total = F.count(F.lit(1))
    share = F.floor(F.lit(100.0) * flagged / total + F.lit(0.5)).cast("long")
    return window.agg(
        total.alias("events"),
        flagged.alias("fraud_events"),
        F.when(total > 0, share).otherwise(F.lit(0).cast("long")).alias("review_rate"),
        F.coalesce(F.sum(F.coalesce(F.col("amount"), F.lit(0))), F.lit(0)).alias("volume"),
    )


def ledger_counts(tx: DataFrame) -> DataFrame:
    fraud = F.count_if(F.col("is_fraud"))
    total = F.count(F.lit(1))
    return tx.agg(
        total.alias("total"),
        fraud.alias("fraud"),
        F.count_if(~F.col("is_fraud")).alias("normal"),
        F.round(F.lit(100.0) * fraud / total, 2).alias("fraud_percentage"),
    )


def class_balance(labelled: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows per class, with the class share."""
    counted = labelled.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Two classes: the total over them is a window over a handful of rows.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.select("label", "n", (F.col("n") / total).alias("share"))


def fraud_type_breakdown(labelled: DataFrame) -> DataFrame:
    return (
        labelled.where(F.col("is_fraud"))
        .groupBy("fraud_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "fraud_type")
    )


def missing_values(df: DataFrame) -> DataFrame:
    """NULLs per column, one pass, one row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "missing")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair; rows where either value is NULL are skipped.

    Each row meets the grouping once per column, so one group's aggregate holds only as
    many correlations as there are columns and stays within generated code.
    """
    reals = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    own = F.array(*[F.struct(F.lit(c).alias("column_a"), F.col(c).alias("own")) for c in columns])
    cells = (
        reals.select(*columns, F.inline(own))
        .groupBy("column_a")
        .agg(*[F.corr("own", c).alias(c) for c in columns])
    )
    return cells.unpivot(["column_a"], columns, "column_b", "correlation")


def feature_histogram(df: DataFrame, widths: dict[str, float], label: str) -> DataFrame:
    """Counts per (feature, class, bin) with fixed bin widths: one combined shuffle."""
    reals = df.select(
        F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in widths]
    )
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    long = reals.unpivot(["label"], list(widths), "feature", "value").where(F.col("value").isNotNull())
    return (
        long.withColumn("bin", F.floor(F.col("value") / width[F.col("feature")]))
        .groupBy("feature", "label", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    )


def feature_quantiles(df: DataFrame, columns: list[str], label: str, probabilities: list[float]) -> DataFrame:
    """Exact quantiles per feature and class: label, feature, probability, value."""
    found = exact_quantiles(df, columns, probabilities, label)
    rows = [(mark, c, p, v) for (mark, c), values in found.items() for p, v in zip(probabilities, values)]
    return df.sparkSession.createDataFrame(rows, "label int, feature string, probability double, value double")


def tx_aggregate(tx: DataFrame, predicate: Column, column: str = "amount") -> DataFrame:
    """count, avg, sum, min, max of a column over the filtered ledger."""
    c = F.col(column)
    return tx.where(predicate).agg(
        F.count(F.lit(1)).alias("count_all"),
        F.count(c).alias("count_value"),
        F.avg(c).alias("avg_value"),
        F.sum(c).alias("sum_value"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
    )


def tx_group_by(
    tx: DataFrame,
    keys: list[str],
    having: Column,
    order_by: list[Column],
    take: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Grouped aggregates with HAVING, ordering by aggregates, skip and take."""
    grouped = (
        tx.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount").alias("sum_amount"),
            F.avg("amount").alias("avg_amount"),
            F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount"),
        )
        .where(having)
        .orderBy(*order_by)
        .offset(skip)
    )
    return grouped if take is None else grouped.limit(take)


def active_currencies(tx: DataFrame) -> DataFrame:
    """The distinct currency codes in one label; a code has three letters, so the set is small."""
    codes = F.array_join(F.sort_array(F.collect_set("currency")), ", ")
    return tx.agg(F.when(codes != "", codes).otherwise(F.lit("None")).alias("currencies"))
