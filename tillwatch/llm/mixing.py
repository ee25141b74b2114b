"""Mixing sources to target weights.

Sources, by code point with NULL last, weigh 1, 2, 3, repeating, and share all words of the corpus by weight.  A source
is repeated at most ``MAX_EPOCHS`` times; what its cap cuts off is shared by weight among the others until none is above.

Within a source the documents stand in the order of a hash-random key.  A source's budget is some whole epochs and a
rest; the rest is cut exactly: the words before each document are a prefix sum, taken in two steps (totals of equal
ranges of the key, then rows within a range), so no task sees a whole source.  The key at the cut, one per source, is all
that goes back to the documents, in a projection without a shuffle of texts.

Defined results: a NULL or blank text has size 0 and takes 0; a NULL source is a source of its own; repeated rows share
one key, and at the cut they share the words left equally, rounded down; without documents the result is empty; other
columns are kept as they are, and the columns added carry the ``prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import PLAIN_WORD, checked_broadcast, stored

MAX_EPOCHS = 3
SEED = "mix-1"
#: Ranges of the key per source: this many leading hex digits.
RANGE_DIGITS = 3
#: Up to so many sources their cuts are broadcast; beyond, the join is Spark's to plan.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def mix_key(docs: DataFrame) -> Column:
    identity = F.concat_ws(":", F.lit(SEED), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit("")))
    return F.md5(identity)


def targets(sizes: list[tuple[str | None, int]], max_epochs: int = MAX_EPOCHS) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, capped, the excess shared again.  `budgets` holds to this."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = {source: i % 3 + 1 for i, (source, _) in enumerate(order)}
    size = dict(order)
    total = sum(size.values())
    capped: set[str | None] = set()
    while True:
        free = [s for s in size if s not in capped]
        left = total - sum(max_epochs * size[s] for s in capped)
        weight = sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * left > max_epochs * size[s] * weight}
        if not above:
            return {s: float(max_epochs * size[s]) if s in capped else (weights[s] * left) / weight for s in size}
        capped |= above


def budgets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, epochs and rest from the sizes (source, size), without collecting them.

    The smaller a source is for its weight, the sooner its cap cuts; so the sources before the first that its cap doesn't
    cut, in this order, are the capped ones, and what they leave is shared by weight.
    """
    # Exact numbers: words times weights can pass 64 bits.
    size = F.col("size").cast("decimal(19,0)")
    weight = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1
    weighed = sizes.select("source", "size", weight.cast("decimal(1,0)").alias("weight"))
    total = weighed.agg(F.sum(size).alias("words"), F.sum("weight").alias("weights"))
    in_order = Window.orderBy(size * F.when(F.col("weight") == 1, 6).when(F.col("weight") == 2, 3).otherwise(2), "weight", F.col("source").isNull(), "source")
    running = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.withColumns({
        "place": F.row_number().over(in_order),
        "size_before": F.coalesce(F.sum(size).over(running), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(running), F.lit(0)),
    })
    ranked = ranked.crossJoin(F.broadcast(total))
    left, weight_left = F.col("words") - max_epochs * F.col("size_before"), F.col("weights") - F.col("weight_before")
    free = F.col("weight") * left <= max_epochs * size * weight_left
    first = ranked.where(free).agg(F.min_by(F.struct("place", left.alias("left"), weight_left.alias("weight")), "place").alias("free"))
    shared = (F.col("weight") * F.col("free.left")).cast("double") / F.col("free.weight").cast("double")
    target = F.when(F.col("place") < F.col("free.place"), (max_epochs * size).cast("double")).otherwise(shared)
    out = ranked.crossJoin(F.broadcast(first)).select("source", F.col("size").alias("source_size"), target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", epochs)
    return out.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, prefix: str = "mix_") -> DataFrame:
    """`docs` with size, source_size, target (of its source) and taken (words, repeats counted) under `prefix`."""
    sized = docs.withColumns({f"{prefix}size": word_count(docs["text"]), f"{prefix}key": mix_key(docs)})
    slim = stored(
        sized.select(F.col("source").cast("string").alias("source"), F.col(f"{prefix}key").alias("key"), F.col(f"{prefix}size").alias("size")),
        "mix",
    )
    sizes = stored(slim.groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    plan = stored(budgets(sizes, max_epochs), "mix-budgets")

    def small(df: DataFrame) -> DataFrame:
        return checked_broadcast(df, BROADCAST_SOURCES)

    span = F.substring("key", 1, RANGE_DIGITS)
    ranges = slim.groupBy("source", span.alias("span")).agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "span", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # The one range of each source in which the rest runs out.
    cut_range = (
        ranges.join(small(plan), ranges["source"].eqNullSafe(plan["source"]))
        .where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("size")))
        .select(ranges["source"].alias("s"), F.col("span").alias("cut_span"), (F.col("rest") - F.col("start")).alias("left"))
    )
    cut_range = stored(cut_range, "mix-ranges")
    rows = slim.join(small(cut_range), slim["source"].eqNullSafe(F.col("s")) & (span == F.col("cut_span")))
    rows = rows.groupBy("source", "key", "left").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(running), F.lit(0)))
    cuts = rows.where((F.col("start") < F.col("left")) & (F.col("left") <= F.col("start") + F.col("size"))).select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("start")) / F.col("copies")).alias("share")
    )
    names = {c: f"__{c}" for c in ("source", "source_size", "target", "epochs", "rest", "cut_key", "share")}
    plan_table = plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").select(*[F.col(c).alias(n) for c, n in names.items()])
    plan_table = stored(plan_table, "mix-plan")
    joined = sized.join(small(plan_table), sized["source"].cast("string").eqNullSafe(F.col("__source")), "left")
    size, key = F.col(f"{prefix}size"), F.col(f"{prefix}key")
    part = F.when(key < F.col("__cut_key"), size).when(key == F.col("__cut_key"), F.col("__share")).otherwise(F.lit(0))
    return joined.select(
        *[sized[c] for c in docs.columns],
        size.alias(f"{prefix}size"),
        F.col("__source_size").alias(f"{prefix}source_size"),
        F.col("__target").alias(f"{prefix}target"),
        (F.col("__epochs") * size + part).cast("long").alias(f"{prefix}taken"),
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )
