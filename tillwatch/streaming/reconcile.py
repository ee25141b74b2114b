"""Exact features for a stream of out-of-order transactions, by recomputing what changed.

Each micro-batch is added to a ledger table, then the batch plan (with its hot-key
handling) runs over the slice of the ledger that can matter, and the profiles of the
affected transactions are upserted:

* every transaction up to three days past a touched one, and
* the next transaction of each touched row's sender, however far ahead (dormancy, speed).

What is touched is a set of days, merged into intervals: a back-dated row costs its own days and not all
between them and today.

A newer version of a known transaction replaces it: the ledger keeps both, the table of
replaced rows says which to skip, and both the old and the new version count as touched.
An older version, or the same one again, changes nothing.  Rows without a time go to the
late table where there is one.

An interval's slice starts three days before its first touched day; before it only the
latest transaction per sender is needed.  Four tables beside the ledger keep a micro-batch from reading all of it, each in
folders that merge as batches come (``tiers``):

* the newest version of every id, cut into buckets by its hash: a micro-batch's ids are looked up in their buckets,
* the time span of every batch: only batches that reach into a slice are read,
* each sender's last transaction, per merged folder: where all of a folder lies before a slice, its one row per
  sender stands for it,
* the replaced rows.

Read row by row before a slice are only batches whose span straddles its start, and those that lost a row to a newer
version.  One row per micro-batch, its span, passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.times import DAY, micros
from ..operators.history import RECEIVER_WINDOW, SENDER
from ..operators.hotkeys import DEFAULT_HEAT, Heat
from ..plans.features import fraud_features
from .runs import BatchTable, newest_per_key
from .tiers import Folder, TieredTable, batches_of, parts_of, standing

SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("batch", "lo", "hi")])


VERSION = ("ts_ms", "ts_us", "ts_ns")
REPLACED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("of_batch", T.LongType()),
        T.StructField("us", T.LongType()),
        T.StructField(SENDER, T.StringType()),
    ]
)


@dataclass(frozen=True)
class Span:
    """The times a batch's rows reach from and to (NULL without rows), and whether one was replaced since."""

    lo: int | None
    hi: int | None
    holed: bool = False


def reaching(spans: dict[int, Span], intervals: list[tuple[int, int]]) -> list[int]:
    """Batches that may hold a row in one of the intervals."""
    return [b for b, s in spans.items() if s.lo is not None and any(s.lo <= high and s.hi >= low for low, high in intervals)]


def cover_before(spans: dict[int, Span], start: int, batch_id: int, fan: int) -> tuple[list[Folder], list[int]]:
    """What has to be read of all that lies before ``start``: whole folders, and single batches row by row."""
    folders, by_row, todo = [], [], standing(batch_id, fan)
    while todo:
        folder = todo.pop()
        mine = [s for s in (spans[b] for b in batches_of(folder, fan)) if s.lo is not None]
        if all(s.lo >= start for s in mine):
            continue
        if all(s.hi < start and not s.holed for s in mine):
            folders.append(folder)
        elif folder[0]:
            todo += parts_of(folder, fan)
        else:
            by_row.append(folder[1])
    return folders, by_row


#: Intervals that a micro-batch recomputes at most; beyond, those closest to one another are taken together.
MAX_INTERVALS = 12


def merged(intervals: list[tuple[int, int]], most: int = MAX_INTERVALS) -> list[tuple[int, int]]:
    """Intervals of whole numbers that overlap or adjoin put together, and then the closest ones until ``most`` are left."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda k: out[k + 1][0] - out[k][1])
        out[i : i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def reconcile_sink(
    ledger: BatchTable,
    features: BatchTable,
    accounts: DataFrame,
    lateness_us: int | None = None,
    late: BatchTable | None = None,
    heat: Heat = DEFAULT_HEAT,
    fan: int = 8,
    id_buckets: int = 16,
):
    """foreachBatch handler.  With ``lateness_us``, rows that far behind the newest row
    of earlier batches go to ``late`` and change nothing.  The version of a row is its
    change time, or its own time where the ledger doesn't carry the former.  ``fan`` folders merge at a time;
    ``id_buckets`` should grow with the ledger, as one task looks up or merges one bucket's ids."""
    spark, path = ledger.spark, ledger.path
    version = [c for c in VERSION if c in ledger.schema.names] or ["created_at"]
    entry = T.StructType([*REPLACED.fields, *[ledger.schema[c] for c in version]])
    spans = TieredTable(spark, f"{path}-spans", SPAN, fan, lambda rows: rows.coalesce(1))
    replaced = TieredTable(spark, f"{path}-replaced", REPLACED, fan)
    lasts = TieredTable(spark, f"{path}-lasts", ledger.schema, fan, lambda rows: _latest(clocked(rows)))
    index = TieredTable(
        spark, f"{path}-ids", entry, fan, lambda rows: newest_per_key(rows, "id", ["of_batch"]), "id", id_buckets
    )

    def clocked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("us", micros("created_at"))

    def _latest(rows: DataFrame) -> DataFrame:
        return newest_per_key(rows, SENDER, ["us", "id"])

    def reaches(batch_id: int) -> dict[int, Span]:
        """The spans after a batch: one row per micro-batch."""
        if batch_id < 0:
            return {}
        holed = {r[0] for r in replaced.read(batch_id).select("of_batch").distinct().collect()}
        return {r.batch: Span(r.lo, r.hi, r.batch in holed) for r in spans.read(batch_id).collect()}

    def alive(batches: list[int], batch_id: int) -> DataFrame:
        """Rows of some batches that are current after ``batch_id``, with the ``batch`` they came in."""
        gone = replaced.read(batch_id).select("id", F.col("of_batch").alias("batch")).distinct()
        return clocked(ledger.read(batches)).join(gone, ["id", "batch"], "left_anti")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = clocked(newest_per_key(batch, "id", version))
        rows.persist()
        try:
            _accept(rows, batch_id)
        finally:
            rows.unpersist()
        _recompute(batch_id)

    def _accept(rows: DataFrame, batch_id: int) -> None:
        """Store the new rows of a batch: neither too late nor older than what is known."""
        fresh = rows
        if late is not None:
            behind = F.col("us").isNull()
            if batch_id > 0 and lateness_us is not None:
                newest = spans.read(batch_id - 1).agg(F.max("hi")).first()[0]
                if newest is not None:
                    behind = behind | (F.col("us") < newest - lateness_us)
            late.sink(rows.where(behind), batch_id)
            fresh = rows.where(~behind)
        if batch_id > 0:
            known = index.lookup(fresh, batch_id - 1).select(
                "id",
                F.struct(*version).alias("known"),
                "of_batch",
                F.col("us").alias("old_us"),
                F.col(SENDER).alias("old_sender"),
            )
            fresh = fresh.join(known, "id", "left").where(
                F.col("known").isNull() | (F.struct(*version) > F.col("known"))
            )
            fresh.persist()
            old = fresh.where(F.col("known").isNotNull())
            old = old.select("id", "of_batch", F.col("old_us").alias("us"), F.col("old_sender").alias(SENDER))
        else:
            old = spark.createDataFrame([], REPLACED)
        # All read what earlier batches stored only, so a repeated batch writes the same.
        replaced.sink(old, batch_id)
        ledger.sink(fresh, batch_id)
        fresh.unpersist()
        added = clocked(ledger.read([batch_id]).drop("batch"))
        index.sink(added.withColumn("of_batch", F.lit(batch_id)), batch_id)
        spans.sink(added.agg(F.lit(batch_id).alias("batch"), F.min("us").alias("lo"), F.max("us").alias("hi")), batch_id)
        lasts.sink(_latest(added.where(F.col(SENDER).isNotNull())), batch_id)

    def _anchors(start: int, batch_id: int, known: dict[int, Span]) -> DataFrame:
        """Each sender's latest transaction before ``start``."""
        folders, by_row = cover_before(known, start, batch_id, fan)
        partly = alive(by_row, batch_id).where((F.col("us") < start) & F.col(SENDER).isNotNull())
        whole = clocked(lasts.folders(folders))
        return _latest(whole.unionByName(partly.select(*ledger.schema.names, "us")))

    def _recompute(batch_id: int) -> None:
        touched = alive([batch_id], batch_id).select("us", SENDER)
        touched = touched.unionByName(replaced.own(batch_id).select("us", SENDER))
        day = F.floor(F.col("us") / DAY).cast("int")
        # As many rows as there are days with a change.
        days = [r[0] for r in touched.where(F.col("us").isNotNull()).select(day).distinct().collect()]
        if not days:
            return
        window = RECEIVER_WINDOW // DAY
        changed_days = merged([(d, d + window) for d in days])
        in_days = lambda spans: reduce(or_, [F.col("us").between(a * DAY, (b + 1) * DAY - 1) for a, b in spans])
        known = reaches(batch_id)
        first, newest = min(days) * DAY, max(s.hi for s in known.values() if s.hi is not None)
        following, points = None, []
        # Where nothing lies after or between the changed days, no other row can follow a touched one.
        if len(changed_days) > 1 or newest >= (changed_days[0][1] + 1) * DAY:
            later = alive(reaching(known, [(first, newest)]), batch_id)
            since = F.col("created_at") >= F.timestamp_micros(F.lit(first))
            following = _following(later.where(since), touched.where(F.col(SENDER).isNotNull()).select(SENDER, F.col("us").alias("at")).distinct())
            following.persist()
            points = [r[0] for r in following.where(~in_days(changed_days)).select(day).distinct().collect()]
        slices = merged([(a - window, b) for a, b in changed_days] + [(p - window, p) for p in points])
        instants = [(a * DAY, (b + 1) * DAY - 1) for a, b in slices]
        times = reduce(or_, [F.col("created_at").between(*(F.timestamp_micros(F.lit(t)) for t in ends)) for ends in instants])
        names = [*ledger.schema.names, "us"]
        inside = alive(reaching(known, instants), batch_id).where(times)
        parts = [inside.select(*names)] + [_anchors(a, batch_id, known).select(*names) for a, _ in instants]
        whole = reduce(DataFrame.unionByName, parts).dropDuplicates(["id"])
        profiled = fraud_features(whole.drop("us", *VERSION), accounts, heat, keep=("us", SENDER))
        if following is None:
            features.sink(profiled.where(in_days(changed_days)), batch_id)
            return
        marked = profiled.join(following.withColumn("follows", F.lit(True)), [SENDER, "us"], "left")
        features.sink(marked.where(in_days(changed_days) | F.col("follows")), batch_id)
        following.unpersist()

    def _following(rows: DataFrame, touched: DataFrame) -> DataFrame:
        """(sender, us): the first time after each touched one at which its sender pays."""
        mine = rows.where(F.col(SENDER).isNotNull()).join(touched.select(SENDER).distinct(), SENDER, "left_semi")
        both = mine.select(SENDER, "us", F.lit(False).alias("asked")).distinct()
        both = both.unionByName(touched.select(SENDER, F.col("at").alias("us"), F.lit(True).alias("asked")))
        after = Window.partitionBy(SENDER).orderBy("us").rangeBetween(1, Window.unboundedFollowing)
        paid = F.when(~F.col("asked"), F.col("us"))
        return both.withColumn("next", F.min(paid).over(after)).where("asked and next is not null").select(SENDER, F.col("next").alias("us")).distinct()

    return handle
