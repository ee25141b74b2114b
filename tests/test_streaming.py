import json
import math
import re

import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.conftest import EPOCH, make_accounts
from tests.test_features import random_rows
from tillwatch.functions.times import DAY
from tillwatch.plans import scoring
from tillwatch.schemas import ACCOUNT, TRANSACTION
from tillwatch.session import work_dir
from tillwatch.sources import cdc, tables
from tillwatch.sources.fixtures import far_future_change
from tillwatch.sources.manifest import CompactingTable
from tillwatch.streaming import history, pipeline
from tillwatch.catalog.streaming import LEDGER_COLUMNS, reconcile_tables
from tillwatch.streaming.reconcile import VERSION, Span, cover_before, merged, reaching, reconcile_sink
from tillwatch.streaming.runs import BatchTable, drain, drain_batches, newest_per_key
from tillwatch.streaming.tiers import TieredTable, batches_of, parts_of, standing

BASE_MS = int(EPOCH.timestamp() * 1000)


def change(row, op="c", late=0, **extra):
    """A change event of a brute-force row; times must be whole milliseconds."""
    i, amount, s, r, lat, lon, us = row
    image = dict(
        id=i, amount=amount, currency="USD", reference=None, description=None, latitude=lat,
        longitude=lon, is_fraud=False, fraud_type=None, risk_score=0, sender_account_id=s,
        receiver_account_id=r, created_at=BASE_MS + us // 1000, **extra,
    )
    ts = BASE_MS + us // 1000 + late
    return json.dumps(
        {"before": None, "after": image, "op": op, "ts_ms": ts, "ts_us": ts * 1000, "ts_ns": ts * 10**6}
    )


def publish(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode(
        "append"
    ).text(path)


def ms_rows(seed, n):
    return [(*r[:6], r[6] // 1000 * 1000) for r in random_rows(seed, n)]


def answers(df):
    return {
        r.transaction_id: (
            r.receiver_txn_count_last_3d, r.unique_senders_last_3d, r.multi_same_amt_count_2d,
            r.sender_txn_count_last_1h, round(float(r.sender_volume_last_1h), 2),
            round(r.days_since_last_trans, 6), round(r.geo_speed_kmh, 3),
        )
        for r in df.collect()
    }


def test_parse_quoted_numbers_and_damage(spark):
    row = ("t1", 5, "a", "b", "11.5", "104.9", 0)
    lines = [change(row), change(row)[:40], "", json.dumps({"before": None, "after": None, "op": "u"})]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = cdc.parse(raw, TRANSACTION)
    assert cdc.unreadable(parsed).count() >= 1
    got = cdc.transactions(raw).collect()
    assert len(got) == 1 and got[0].latitude == 11.5


def test_latest_state(spark):
    row = ("t1", 5, "a", "b", None, None, 0)
    gone = ("t2", 5, "a", "b", None, None, 0)
    delete = json.loads(change(gone, "d", 9))
    delete["before"], delete["after"] = delete["after"], None
    lines = [change(row), change(row, "u", 2), change((*row[:1], 7, *row[2:]), "u", 5), change(gone), json.dumps(delete)]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = cdc.latest_state(cdc.parse(raw, TRANSACTION), TRANSACTION).collect()
    assert [(r.id, float(r.amount)) for r in rows] == [("t1", 7.0)]


def follow(spark, arrivals, path=None, **options):
    """Arrivals, one list of messages after the other, through a flow."""
    path = path or work_dir(spark, "arrivals")
    flow = None
    for lines in arrivals:
        publish(spark, path, lines)
        if flow is None:
            raw = tables.line_stream(spark, path)
            flow = pipeline.FeatureFlow(raw, work_dir(spark, "flow"), make_accounts(spark, ["a", "b"]), shards=2, **options)
        flow.advance()
    return flow


@pytest.mark.parametrize("busy_rows", [10**9, 15], ids=["plain", "salted"])
def test_flow_follows_corrections_out_of_order(spark, busy_rows):
    rows = ms_rows(21, 120)
    minute = 60_000_000
    changed = {}
    for n in range(0, 120, 6):  # new amount and label, other receiver, other time, swapped accounts
        i, amount, s, r, lat, lon, us = rows[n]
        changed[i] = [
            (i, amount + 500, s, r, lat, lon, us),
            (i, amount, s, "hub" if r != "hub" else "x", lat, lon, us),
            (i, amount, s, r, lat, lon, us + (n - 60) * 30 * minute),
            (i, amount, r, s, lat, lon, us),
        ][n // 6 % 4]
    day = 86_400_000
    updates = [change(r, "u", 30 * day) for r in changed.values()]
    back = [change(rows[n], "u", 10 * day) for n in (0, 18)]  # outdone, whenever it comes
    arrivals = [
        [change(r) for r in rows[::3]] + back[:1],
        [change(r) for r in rows[1::3]] + updates[:8],
        [change(r) for r in rows[2::3]] + updates[8:] + [change(rows[5])],
        back[1:] + updates[3:5] + [change(rows[7])],
    ]
    flow = follow(spark, arrivals, lateness_us=90 * DAY, correctable_us=90 * DAY, busy_rows=busy_rows, salts=3)
    current = [changed.get(r[0], r) for r in rows]
    assert answers(flow.features()) == brute.profile(current)
    assert flow.intake.busy.read().isEmpty() == (busy_rows > 1000)
    assert {r.id: float(r.amount) for r in flow.newest().collect()} == {r[0]: float(r[1]) for r in current}


def test_flow_forgets_what_can_not_change(spark):
    """Buckets behind the clock leave the state, answers stay those of the whole ledger, dormancy has no limit."""
    rows = [(f"t{k:03}", 10, "ab"[k % 2], "x", "11.5", "104.9", k * 6 * 3_600_000_000) for k in range(160)]  # 40 days
    rows += [("u0", 5, "rests", "x", "11.0", "104.0", 0), ("u1", 5, "rests", "x", "12.0", "104.0", 39 * DAY)]
    ordered = sorted(rows, key=lambda r: r[6])
    arrivals = [[change(r) for r in ordered[i : i + 27]] for i in range(0, len(ordered), 27)]
    path = work_dir(spark, "arrivals")
    flow = follow(spark, arrivals, path, lateness_us=DAY, correctable_us=DAY)
    assert answers(flow.features()) == brute.profile(rows)
    late = flow.intake.late.read()
    assert late.isEmpty()
    publish(spark, path, [change(("v", 1, "a", "x", None, None, 40 * DAY))])
    flow.start_intake(availableNow=True).awaitTermination()
    flow.start_versions(availableNow=True).awaitTermination()
    run = flow.start_answers(availableNow=True)
    run.awaitTermination()
    # Of 40 days and two key spaces, the last few days' buckets are left.
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] < 60


def test_flow_puts_each_message_in_one_place(spark):
    rows = ms_rows(25, 30)
    first = max(r[6] for r in rows)
    old = ("old", 5, "a", "b", None, None, first - 3 * 3_600_000_000)
    gone = json.loads(change(("gone", 5, "a", "b", None, None, first)))
    gone["after"]["created_at"] = None
    nameless = json.loads(change((None, 5, "a", "b", None, None, first)))
    delete = json.loads(change(rows[0], "d"))
    broken = [json.dumps(gone), json.dumps(nameless), change(rows[0])[:40], "", "junk"]
    arrivals = [[change(r) for r in rows], [change(old), change((*old[:1], 6, *old[2:]), "u", 5), *broken, json.dumps(delete)], [change(max(rows, key=lambda r: r[6]))]]
    flow = follow(spark, arrivals[:1] + [arrivals[1][:1] + arrivals[1][2:]] + arrivals[2:], lateness_us=2 * 3_600_000_000)
    assert [r.id for r in flow.intake.late.read().collect()] == ["old"]
    assert sorted(r.reason for r in flow.intake.quarantine.read().collect()) == ["no id", "no time", *["unreadable message"] * 3]
    assert flow.intake.accepted.read().count() == len(rows) + 1
    assert answers(flow.features()) == brute.profile(rows)
    # Its correction may come later than a first version.
    flow = follow(spark, arrivals, lateness_us=2 * 3_600_000_000)
    assert answers(flow.features()) == brute.profile([*rows, (*old[:1], 6, *old[2:])])


def test_a_batch_again_changes_nothing(spark):
    rows = ms_rows(26, 40)
    flow = follow(spark, [[change(r) for r in rows[:25]], [change(r) for r in rows[25:]]], lateness_us=90 * DAY)
    for table in (flow.versions, flow.partials):
        batch = table.read().where("batch >= 0")
        last = batch.agg(F.max("batch")).first()[0]
        table.sink(batch.where(F.col("batch") == last).drop("batch").cache(), last + 1000)  # delivered again
    assert answers(flow.features()) == brute.profile(rows)
    flow.start_answers(availableNow=True).awaitTermination()  # reads the versions that came again
    assert answers(flow.features()) == brute.profile(rows)


def test_scores_follow_the_answers(spark, monkeypatch):
    """The newest event of each transaction stands on its newest profile."""
    rows = ms_rows(27, 30)
    monkeypatch.setattr(pipeline.quality, "check_requests", lambda df: df.withColumn("valid", F.lit(True)).withColumn("reasons", F.lit("")))
    monkeypatch.setattr(pipeline.rules, "alerts", lambda df, _: df.withColumns({"scenarios": F.array(F.lit("")), "risk_score": F.col("receiver_txn_count_last_3d").cast("int"), "action": F.lit("")}))
    monkeypatch.setattr(pipeline.scoring, "score_batch", lambda df, *_: df)
    monkeypatch.setattr(pipeline.scoring, "event_value", lambda _: F.lit(""))
    path = work_dir(spark, "arrivals")
    events = BatchTable(spark, work_dir(spark, "events"), spark.createDataFrame([], "key string, risk_score int").schema)
    refused = BatchTable(spark, work_dir(spark, "refused"), spark.createDataFrame([], "transaction_id string").schema)
    flow = None
    for part in (rows[::2], rows[1::2]):
        publish(spark, path, [change(r) for r in part])
        if flow is None:
            flow = pipeline.FeatureFlow(tables.line_stream(spark, path), work_dir(spark, "flow"), make_accounts(spark, ["a", "b"]), lateness_us=90 * DAY, shards=2)
        flow.advance()
        flow.start_scoring(events, refused, None, None, None, availableNow=True).awaitTermination()
    kept = {r.key: r.risk_score for r in events.current("key", ["batch"]).collect()}
    assert kept == {i: a[0] for i, a in brute.profile(rows).items()}


def test_reconcile_out_of_order(spark):
    rows = ms_rows(22, 60)
    path = work_dir(spark, "arrivals")
    for part in (rows[::3], rows[1::3], rows[2::3]):
        publish(spark, path, [change(r) for r in part])
    columns = [
        "id", "amount", "sender_account_id", "receiver_account_id", "latitude", "longitude",
        "is_fraud", "fraud_type", "created_at",
    ]
    stream = cdc.transactions(tables.line_stream(spark, path, files_per_batch=1)).select(*columns)
    ledger = BatchTable(spark, work_dir(spark, "ledger"), stream.schema)
    schema = (
        "transaction_id string, us long, sender_account_id string, trans_amount decimal(18,2), "
        "age_hours_open_acc double, receiver_txn_count_last_3d long, unique_senders_last_3d long, "
        "multi_same_amt_count_2d long, sender_txn_count_last_1h long, "
        "sender_volume_last_1h decimal(28,2), days_since_last_trans double, geo_speed_kmh double, "
        "is_fraud boolean, fraud_type string"
    )
    features = BatchTable(
        spark, work_dir(spark, "features"), spark.createDataFrame([], schema).schema
    )
    handle = reconcile_sink(ledger, features, make_accounts(spark, ["a", "b"]))
    drain_batches(stream, "reconcile", handle)
    # A batch that runs again changes nothing.
    last = ledger.read().where("batch = 2").drop("batch")
    handle(last, 2)
    assert answers(features.current("transaction_id", ["us"])) == brute.profile(rows)


def test_reconcile_updates(spark):
    """A newer version moves, re-prices and re-routes a transaction; an older one and a NULL time change nothing."""
    rows = ms_rows(23, 40)
    minute = 60_000_000
    changed = {}
    for n in (3, 11, 19):
        i, amount, s, r, lat, lon, us = rows[n]
        changed[i] = (i, amount + 500, r, s, lat, lon, us + (n - 10) * 30 * minute)
    late_by = 10 * 24 * 3600 * 1000
    path = work_dir(spark, "arrivals")
    publish(spark, path, [change(r) for r in rows[::2]])
    publish(spark, path, [change(r) for r in rows[1::2]])
    publish(spark, path, [change(r, "u", late_by) for r in changed.values()])
    lost = json.loads(change(("lost", 1, "a", "b", None, None, 0)))
    lost["after"]["created_at"] = None
    publish(spark, path, [change(rows[3]), change(rows[4]), json.dumps(lost)])
    stream = cdc.transactions(tables.line_stream(spark, path, files_per_batch=1), *VERSION)
    ledger, late, profiles = reconcile_tables(spark, stream.select(*LEDGER_COLUMNS, *VERSION))
    handle = reconcile_sink(ledger, profiles, make_accounts(spark, ["a", "b"]), None, late)
    drain_batches(stream.select(*LEDGER_COLUMNS, *VERSION), "updates", handle)
    current = [changed.get(r[0], r) for r in rows]
    assert answers(profiles.current("transaction_id", [])) == brute.profile(current)
    assert [r.id for r in late.read().collect()] == ["lost"]


def test_touched_days_merge():
    assert merged([(5, 8), (1, 3), (4, 4), (20, 21), (7, 10)]) == [(1, 10), (20, 21)]
    assert merged([(0, 1), (10, 11), (14, 15), (40, 41)], 2) == [(0, 15), (40, 41)]
    assert merged([]) == []


def test_a_back_dated_row_recomputes_its_neighbours_only(spark):
    """Ninety days of a ledger, then one row of a month ago: few profiles are written, and all are right."""
    hour = 3_600_000_000
    rows = [(f"t{k:03}", 10 + k % 3, "abc"[k % 3], "xy"[k % 2], "11.5", "104.9", k * 9 * hour) for k in range(240)]
    rows.append(("rest", 7, "rests", "x", "12.0", "104.0", 80 * DAY))
    back = ("back", 10, "rests", "x", "11.0", "104.0", 55 * DAY)
    path = work_dir(spark, "arrivals")
    for part in (rows[::2], rows[1::2], [back]):
        publish(spark, path, [change(r) for r in part])
    stream = cdc.transactions(tables.line_stream(spark, path, files_per_batch=1), *VERSION).select(*LEDGER_COLUMNS, *VERSION)
    ledger, _, profiles = reconcile_tables(spark, stream)
    drain_batches(stream, "back", reconcile_sink(ledger, profiles, make_accounts(spark, ["a", "b"])))
    assert answers(profiles.current("transaction_id", [])) == brute.profile([*rows, back])
    written = profiles.read().where("batch = 2")
    # Four days of nine-hour steps, itself, and the sender's next payment 25 days on.
    assert written.count() <= 14 and {"back", "rest"} <= {r.transaction_id for r in written.collect()}


def test_reconcile_over_merged_folders(spark):
    """Four batches, folders merged by twos: a corrected row, and the same one corrected again after the merge."""
    rows = ms_rows(24, 36)
    late_by = 10 * 24 * 3600 * 1000
    i, amount, s, r, lat, lon, us = rows[2]
    once, twice = (i, amount + 500, r, s, lat, lon, us), (i, amount + 900, s, r, lat, lon, us + 3_600_000_000)
    path = work_dir(spark, "arrivals")
    publish(spark, path, [change(r) for r in rows[::2]])
    publish(spark, path, [change(r) for r in rows[1::4]] + [change(once, "u", late_by)])
    publish(spark, path, [change(r) for r in rows[3::4]])
    publish(spark, path, [change(twice, "u", 2 * late_by), change(rows[5])])
    stream = cdc.transactions(tables.line_stream(spark, path, files_per_batch=1), *VERSION).select(*LEDGER_COLUMNS, *VERSION)
    ledger, _, profiles = reconcile_tables(spark, stream)
    handle = reconcile_sink(ledger, profiles, make_accounts(spark, ["a", "b"]), fan=2, id_buckets=2)
    drain_batches(stream, "merged", handle)
    current = [twice if row[0] == i else row for row in rows]
    assert answers(profiles.current("transaction_id", [])) == brute.profile(current)


def test_standing_folders_hold_each_batch_once():
    for fan in (2, 3, 8):
        for last in range(200):
            found = standing(last, fan)
            assert [b for f in found for b in batches_of(f, fan)] == list(range(last + 1))
            assert len(found) <= (fan - 1) * (1 + math.log(last + 1, fan)) + 1e-9
            for folder in found:
                if folder[0]:
                    parts = parts_of(folder, fan)
                    assert [b for f in parts for b in batches_of(f, fan)] == list(batches_of(folder, fan))


def test_what_lies_before_a_slice():
    """In-order batches of ten: what is read doesn't grow with their number; holes and late rows are read one by one."""
    read = {}
    for count in (50, 500):
        spans = {b: Span(10 * b, 10 * b + 9) for b in range(count)}
        near = reaching(spans, [(10 * count - 45, 10 * count)])
        folders, by_row = cover_before(spans, 10 * count - 45, count - 1, 4)
        read[count] = len(near), len(by_row)
        whole = {b for f in folders for b in batches_of(f, 4)}
        assert whole | set(by_row) == set(range(count - 4)) and not whole & set(by_row)
        assert len(folders) <= 3 * (1 + math.log(count, 4)) + 3
    assert read[50] == read[500] == (5, 1)
    spans = {b: Span(10 * b, 10 * b + 9, b == 3) for b in range(16)} | {7: Span(None, None), 9: Span(5, 500)}
    folders, by_row = cover_before(spans, 120, 15, 4)
    assert sorted(by_row) == [3, 9]
    assert {b for f in folders for b in batches_of(f, 4)} - {7} == set(range(12)) - {3, 7, 9}


def test_lookups_read_few_files_after_fifty_batches(spark):
    schema = spark.createDataFrame([], "id string, v long").schema
    newest = lambda rows: newest_per_key(rows, "id", ["v"])
    table = TieredTable(spark, work_dir(spark, "tiers"), schema, 4, newest, "id", 4)
    asked = spark.createDataFrame([("a3",), ("gone",)], "id string")
    files = {}
    for b in range(50):
        rows = [(f"a{b}", b), ("a3", b)] if b % 5 == 0 else [(f"a{b}", b)]
        table.sink(spark.createDataFrame(rows, schema), b)
        if b in (6, 49):
            table.sink(spark.createDataFrame(rows, schema), b)  # comes again
            found = table.lookup(asked, b)
            assert re.search(r"PartitionFilters: \[[^]]*bucket#", found._jdf.queryExecution().toString())
            hit = {f"/bucket={r[0]}/" for r in asked.select(table._bucket()).collect()}
            files[b] = sum(any(h in name for h in hit) for name in found.inputFiles())
            assert [(r.id, r.v) for r in found.collect()] == [("a3", b // 5 * 5)]
    assert files[49] <= 2 * len(standing(49, 4)) <= 12
    assert {r.id: r.v for r in newest(table.read(49)).collect()} == {f"a{b}": b for b in range(50)} | {"a3": 45}


def test_missing_amounts_add_nothing():
    import pandas as pd

    rows = pd.DataFrame({"code": 0, "us": [1, 2, 3], "id": ["a", "b", "c"], "cents": [100, None, None], "lat": None, "lon": None})
    got = history.sender_answers(rows, rows.assign(us=10, cents=[None, None, 100.0]))
    assert list(got["cents"]) == [100] * 3 and list(got["repeats"]) == [0, 0, 1]


def test_upsert_is_idempotent(spark):
    schema = spark.createDataFrame([], "id string, v long").schema
    table = BatchTable(spark, work_dir(spark, "upserts"), schema)
    put = table.upsert_sink("id", ["v"])
    one = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], schema)
    two = spark.createDataFrame([("a", 2), ("b", 5)], schema)
    put(one, 0), put(two, 1), put(two, 1)
    want = {"a": 3, "b": 5}
    assert {r.id: r.v for r in table.current("id", ["v"]).collect()} == want
    small = table.compact("id", ["v"], work_dir(spark, "compact"))
    assert {r.id: r.v for r in small.current("id", ["v"]).collect()} == want


def test_compaction_under_readers(spark):
    schema = spark.createDataFrame([], "id string, v long").schema
    table = CompactingTable(spark, work_dir(spark, "compacting"), schema, "id", ["v"], every=2)
    table.create()
    assert table.current().collect() == []
    batches = [spark.createDataFrame([(f"k{i % 3}", i), ("x", 9 - i)], schema) for i in range(6)]
    seen, pinned = {}, None
    for i, batch in enumerate(batches):
        table.sink(batch, i)
        table.sink(batch, i)  # comes again
        at = table.manifest.current()
        seen[at] = {r.id: r.v for r in table.current(at).collect()}
        if i == 1:
            pinned = table.current(at)  # a reader that starts before the folders are merged
    want = {"k0": 3, "k1": 4, "k2": 5, "x": 9}
    assert {r.id: r.v for r in table.current().collect()} == want
    assert {r.id: r.v for r in pinned.collect()} == {"k0": 0, "k1": 1, "x": 9}
    assert all({r.id: r.v for r in table.current(at).collect()} == rows for at, rows in seen.items())
    assert len(table.manifest.entries(table.manifest.current())) <= 2
    # Six batches and two merges after the first version, which is empty.
    assert table.manifest.current() == 8
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        table.manifest.publish([], 3)  # someone else published the version after it


def test_prediction_envelope(spark):
    row = spark.range(1).select(
        F.lit("t").alias("transaction_id"), F.lit("a").alias("sender_account_id"),
        F.lit("b").alias("receiver_account_id"), F.lit(False).alias("is_fraud"),
        F.lit(0.25).alias("fraud_probability"), F.lit(None).cast("string").alias("fraud_type"),
        F.lit("fraud-model-v1").alias("model_version"),
        *[F.lit(1).cast("decimal(18,2)").alias(c) for c in scoring.PROFILE],
    )
    out = scoring.prediction_events(row).first()
    event = json.loads(out.value)
    assert out.key == "t" and event["event_type"] == "FRAUD_PREDICTION" and event["event_version"] == "1.0"
    assert event["prediction"]["fraud_type"] is None
    assert len(event["prediction"]["features"]) == 9
    assert isinstance(event["prediction"]["features"]["trans_amount"], float)
    assert event["event_time"].endswith("+00:00")


def test_account_changes_do_not_multiply_counts(spark):
    acc = ("x", "10", "n", "SAVINGS", "ACTIVE", 1, "USD", "u", BASE_MS, BASE_MS)
    names = [f.name for f in ACCOUNT]
    lines = []
    for k in range(3):
        image = dict(zip(names, acc)) | {"balance": k}
        lines.append(json.dumps({"before": None, "after": image, "op": "u", "ts_ms": k, "ts_us": k, "ts_ns": k}))
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = cdc.latest_state(cdc.parse(raw, ACCOUNT), ACCOUNT).collect()
    assert len(rows) == 1 and float(rows[0].balance) == 2.0


def test_session_expiry(spark):
    rows = [(f"t{k}", 1, "a", "b", None, None, us) for k, us in enumerate([0, DAY, 9 * DAY])]
    path = work_dir(spark, "idle")
    sentinel = [r.value for r in far_future_change(spark).collect()]
    publish(spark, path, [change(r) for r in rows] + sentinel)
    tx = pipeline.transaction_stream(tables.line_stream(spark, path))
    closed = drain(pipeline.idle_sessions(tx, "sender_account_id"), "idle").collect()
    assert sorted(r.n for r in closed if r.sender_account_id == "a") == [1, 2]


def test_unreadable_feature_messages_go_to_quarantine(spark, monkeypatch):
    good = json.dumps({"transaction_id": "t1", "trans_amount": 5, "computed_us": 1})
    raw = spark.createDataFrame([(x,) for x in (good, good[:20], "junk", "{}", None)], "value string")
    rows = pipeline.feature_stream(raw)
    # Neither rules nor a model are needed to see where a message goes.
    checked = lambda df: df.withColumn("valid", F.lit(False)).withColumn("reasons", F.lit("refused"))
    monkeypatch.setattr(pipeline.quality, "check_requests", checked)
    monkeypatch.setattr(pipeline.rules, "alerts", lambda df, _: df.withColumns({"scenarios": F.array(F.lit("")), "risk_score": F.lit(0), "action": F.lit("")}))
    monkeypatch.setattr(pipeline.scoring, "score_batch", lambda df, *_: df)
    monkeypatch.setattr(pipeline.scoring, "event_value", lambda _: F.lit(""))
    events = BatchTable(spark, work_dir(spark, "events"), spark.createDataFrame([], "key string").schema)
    refused = BatchTable(spark, work_dir(spark, "refused"), spark.createDataFrame([], "transaction_id string, reasons string, unreadable string").schema)
    pipeline.scoring_sink(events, refused, None, None, None)(rows, 0)
    got = {(r.transaction_id, r.reasons, r.unreadable) for r in refused.read().collect()}
    assert got == {("t1", "refused", None), *[(None, "unreadable message", x) for x in (good[:20], "junk", "{}")]}


class KeptState:
    """Stands for the state handle: maps and values in memory."""

    def __init__(self):
        self.maps, self.value = {}, None

    def getMapState(self, name, *_):
        return KeptMap(self.maps.setdefault(name, {}))

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class KeptMap:
    def __init__(self, rows):
        self.rows = rows

    def keys(self):
        return iter(list(self.rows))

    def getValue(self, key):
        return self.rows[next(k for k in self.rows if k == key or k == (key,))]

    def updateValue(self, key, value):
        self.rows[key if len(key) > 1 else (key[0],)] = value

    def removeKey(self, key):
        del self.rows[next(k for k in self.rows if k == key or k == (key,))]


@pytest.mark.parametrize("space", ["receiver", "sender"])
def test_a_firing_is_answered_in_slices_of_time(monkeypatch, space):
    """Slices of some rows give the answers of the whole, corrections and messages that come twice included, and hold few rows."""
    import random

    import pandas as pd

    rng = random.Random(8)
    hour = 3_600_000_000
    versions, lefts = {}, []
    for k in range(400):
        us = rng.randrange(60 * 24) * hour
        versions[k] = [(f"k{rng.randrange(4)}", us, f"t{k}", 1, f"o{rng.randrange(5)}", rng.choice([100, 200, None]), rng.choice([1.0, None]), 2.0, True, False)]
    for k in range(0, 400, 7):  # moved in time or to another key: the place left is marked
        key, us, *rest = versions[k][0]
        lefts.append((key, us, rest[0], 2, *rest[2:6], True, True))
        versions[k].append((f"k{rng.randrange(4)}", us + rng.randrange(-200, 200) * hour, rest[0], 2, *rest[2:6], True, False))
    first = [versions[k][0] for k in range(400)]
    second = [v[1] for v in versions.values() if len(v) > 1] + lefts
    some = rng.sample(first, 260)
    arrivals = [some, [r for r in first if r not in some] + some[:20] + second[:30], second, second[5:9]]
    sizes = []
    kept = {}
    for slice_rows in (25, 10**9):
        processor, state, newest = history.HistoryProcessor(400 * DAY, slice_rows), KeptState(), {}
        processor.init(state)
        widest = 0
        name = f"{space}_answers"
        answer = getattr(history, name)
        with monkeypatch.context() as patch:
            patch.setattr(history, name, lambda rows, ask: sizes.append(len(rows)) or answer(rows, ask))
            for rows in arrivals:
                frame = pd.DataFrame(rows, columns=history.ROW_COLUMNS).assign(salt=0, clock=None)
                chunks = (frame.iloc[i : i + 50] for i in range(0, len(frame), 50))
                for out in processor.handleInputRows((space, 0), chunks, None):
                    assert out.groupby("id").size().max() <= 2  # one row of a transaction in each of two places at most
                    for r in out.astype(object).where(out.notna(), None).to_dict("records"):
                        newest[r["id"], r["seq"], r["us"]] = {c: v for c, v in r.items() if c not in ("turn", "salt")}
        widest, sizes[:] = max(sizes), []
        kept[slice_rows] = newest, widest
    assert kept[25][0] == kept[10**9][0] and len(kept[25][0]) > 400
    assert kept[25][1] * 3 < kept[10**9][1]
    assert kept[10**9][1] > 300
    current = {v[-1][2]: v[-1] for v in versions.values()}
    for (i, seq, us), got in kept[25][0].items():
        row = current[i]
        if seq != row[3]:
            continue
        mine = [r for r in current.values() if r[0] == row[0] and r[1] < row[1]]
        if space == "receiver":
            near = [r for r in mine if r[1] >= row[1] - 3 * DAY]
            assert (got["incoming"], got["senders"]) == (len(near), len({r[4] for r in near}))
        else:
            near = [r for r in mine if r[1] >= row[1] - hour]
            same = [r for r in mine if r[1] >= row[1] - 2 * DAY and r[5] is not None and r[5] == row[5]]
            assert (got["paced"], got["cents"], got["repeats"]) == (len(near), sum(r[5] or 0 for r in near), len(same))
            last = max(mine, key=lambda r: (r[1], r[2]), default=None)
            assert (got["previous_us"], got["previous_id"]) == (last[1:3] if last else (None, None))


def test_no_writer_has_a_batch_to_itself(spark):
    """Messages of eight tasks come in three micro-batches, each written by all of them."""
    from tillwatch.catalog.streaming import arriving

    lines = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("value"))
    seen = {}
    drain_batches(arriving(spark, lines, "arriving"), "arriving", lambda batch, i: seen.setdefault(i, [(r.value, r.f) for r in batch.select("value", F.input_file_name().alias("f")).collect()]))
    assert sorted(v for rows in seen.values() for v, _ in rows) == sorted(f"m{k}" for k in range(4000))
    assert len(seen) == 3 and all(len({f for _, f in rows}) == 8 for rows in seen.values())
    assert max(sum(f == g for _, g in rows) for rows in seen.values() for f in {f for _, f in rows}) < 4000 / 3 / 4


def test_next_payments_are_not_looked_for_where_nothing_lies_after(spark, monkeypatch):
    """Batches that come in order, and one that touches every day: all that can change lies in the touched days."""
    rows = sorted(ms_rows(29, 45), key=lambda r: r[6])
    path = work_dir(spark, "arrivals")
    for part in (rows[:20], rows[20:40:2], rows[21:40:2] + rows[40:]):
        publish(spark, path, [change(r) for r in part])
    stream = cdc.transactions(tables.line_stream(spark, path, files_per_batch=1), *VERSION).select(*LEDGER_COLUMNS, *VERSION)
    ledger, _, profiles = reconcile_tables(spark, stream)
    monkeypatch.setattr("tillwatch.streaming.reconcile.Window", None)  # what finds the next payments
    drain_batches(stream, "ordered", reconcile_sink(ledger, profiles, make_accounts(spark, ["a", "b"])))
    assert answers(profiles.current("transaction_id", [])) == brute.profile(rows)
