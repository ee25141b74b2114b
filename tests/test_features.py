import random

import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.conftest import EAGER, make_accounts, make_ledger
from tillwatch.functions.times import DAY, HOUR
from tillwatch.operators import joins, windows
from tillwatch.operators.history import RECEIVER, SENDER, sender_history, with_clock
from tillwatch.operators.hotkeys import DEFAULT_HEAT, Heat, hot_sets, lookup
from tillwatch.operators.trailing import in_lanes, trailing
from tillwatch.plans.features import (
    account_age,
    fraud_features,
    ledger_rows,
    target_transactions,
)


def random_rows(seed, n=160):
    """Few keys, a coarse clock (many ties), exact window boundaries, NULLs, one hub."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        us = rng.choice([0, HOUR, DAY, 2 * DAY, 3 * DAY]) + rng.randrange(0, 6) * HOUR // 2
        us += rng.choice([0, 0, 0, 1, -1])
        sender = rng.choice(["a", "a", "a", "b", "c", None])
        receiver = rng.choice(["hub", "hub", "x", "y"])
        lat = rng.choice(["11.5564", "48.8566", None, "12.25"])
        rows.append((f"t{k:04d}", rng.choice([10, 20, 30.5]), sender, receiver, lat, "104.9", us))
    return rows


def got_profile(spark, rows, heat):
    tx = make_ledger(spark, rows)
    acc = make_accounts(spark, ["a", "b", "hub", "x", "y"])
    found = fraud_features(tx, acc, heat).collect()
    return {
        r.transaction_id: (
            r.receiver_txn_count_last_3d,
            r.unique_senders_last_3d,
            r.multi_same_amt_count_2d,
            r.sender_txn_count_last_1h,
            round(float(r.sender_volume_last_1h), 2),
            round(r.days_since_last_trans, 6),
            round(r.geo_speed_kmh, 3),
        )
        for r in found
    }, found


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "heat",
    [DEFAULT_HEAT, EAGER, Heat(min_rows=40, max_keys=1, lane_rows=10)],
    ids=["ordinary", "all hot", "one hot"],
)
def test_profile_equals_brute_force(spark, seed, heat):
    rows = random_rows(seed)
    got, _ = got_profile(spark, rows, heat)
    assert got == brute.profile(rows)


@pytest.mark.parametrize("heat", [DEFAULT_HEAT, EAGER], ids=["ordinary", "hot"])
def test_window_edges(spark, heat):
    base = 10 * DAY
    rows = [
        ("edge", 5, "a", "r", None, None, base - 3 * DAY),
        ("outside", 5, "b", "r", None, None, base - 3 * DAY - 1),
        ("twin1", 5, "c", "r", None, None, base),
        ("twin2", 5, "d", "r", None, None, base),
        ("null1", 7, None, "q", None, None, base),
        ("null2", 7, None, "q", None, None, base + 60_000_000),
        ("nocoord", 1, "e", "z", None, None, base),
        ("after", 1, "e", "z", "11.5", "104.9", base + HOUR),
    ]
    got, _ = got_profile(spark, rows, heat)
    assert got["twin1"][:2] == (1, 1) and got["twin2"][:2] == (1, 1)
    assert got["null2"] == (1, 0, 0, 0, 0.0, 9999.0, 0.0)
    assert got["after"][6] == 0.0
    assert got["after"][3] == 1  # exactly one hour earlier is inside


def test_speed_and_age(spark):
    rows = [
        ("p", 1, "a", "x", "11.5564", "104.9282", 0),
        ("q", 1, "a", "x", "48.8566", "2.3522", HOUR // 2),
        ("n", 1, "ghost", "x", None, None, 0),
    ]
    got, found = got_profile(spark, rows, DEFAULT_HEAT)
    assert got["q"][6] == pytest.approx(19881.1653, abs=1e-3)
    ages = {r.transaction_id: r.age_hours_open_acc for r in found}
    assert ages["p"] == 1.0 and ages["q"] == 1.5 and ages["n"] is None


def test_whole_second_age(spark):
    tx = make_ledger(spark, [("a", 1, "s", "r", None, None, 1_999_999)])
    acc = make_accounts(spark, ["s"], opened_us=0)
    row = account_age(tx, acc).first()
    assert row.age_hours_whole_seconds == pytest.approx(1 / 3600)
    assert row.age_hours_open_acc == pytest.approx(1.999999 / 3600)


def test_lookup_keeps_every_row(spark):
    rows = random_rows(7)
    tx, acc = make_ledger(spark, rows), make_accounts(spark, ["a", "b", "hub"])
    for heat in (DEFAULT_HEAT, EAGER):
        out = target_transactions(tx, acc, heat)
        assert out.count() == len(rows)
        assert out.where(F.col(SENDER).isNull() & F.col("sender_account").isNotNull()).count() == 0
        assert out.where((F.col(SENDER) == "c") & F.col("sender_account").isNotNull()).count() == 0
        assert out.where((F.col(SENDER) == "a") & F.col("sender_account").isNull()).count() == 0


def test_hot_set_is_bounded_and_reports_nulls(spark):
    tx = with_clock(make_ledger(spark, random_rows(3)))
    found = hot_sets(tx, [RECEIVER, SENDER], Heat(min_rows=2, max_keys=1, lane_rows=5))
    assert found[SENDER].has_null and not found[RECEIVER].has_null
    assert found[RECEIVER].rows.count() + found[SENDER].rows.count() <= 4
    none = hot_sets(tx, [RECEIVER], DEFAULT_HEAT)
    assert none[RECEIVER].rows is None


@pytest.mark.parametrize("heat", [DEFAULT_HEAT, EAGER], ids=["ordinary", "hot"])
def test_trailing_equals_sliding_frame(spark, heat):
    from pyspark.sql import Window

    rows = with_clock(make_ledger(spark, random_rows(11))).select("id", "us", SENDER, "amount")
    width = DAY
    got = trailing(rows, [SENDER, "amount"], width, {"n": F.lit(1).cast("long"), "v": F.col("amount")}, heat)
    frame = Window.partitionBy(SENDER, "amount").orderBy("us").rangeBetween(-width, -1)
    known = F.col(SENDER).isNotNull()
    want = rows.select(
        "id",
        F.when(known, F.count(F.lit(1)).over(frame)).otherwise(0).alias("n"),
        F.when(known, F.coalesce(F.sum("amount").over(frame), F.lit(0))).otherwise(0).alias("v"),
    )
    assert sorted((r.id, r.n, float(r.v)) for r in got.collect()) == sorted(
        (r.id, r.n, float(r.v)) for r in want.collect()
    )


def test_lanes_hold_so_many_rows_however_they_lie(spark):
    """Nine in ten rows of a key within an hour, one moment of many rows, and a key of few."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hub").alias("k"),
        F.when(F.col("id") % 10 == 0, F.col("id") * 97_000_000)
        .when(F.col("id") % 7 == 0, 5 * HOUR)
        .otherwise(5 * HOUR + F.col("id") * 7919 % HOUR)
        .alias("us"),
        "id",
    )
    laned = in_lanes(rows, ["k"], ["us", "id"], 300).collect()
    sizes, ends = {}, {}
    for r in laned:
        sizes[r.k, r.lane] = sizes.get((r.k, r.lane), 0) + 1
        low, high = ends.get((r.k, r.lane), ((r.us, r.id), (r.us, r.id)))
        ends[r.k, r.lane] = min(low, (r.us, r.id)), max(high, (r.us, r.id))
    assert len(laned) == 20_000 and max(sizes.values()) <= 300
    for k in ("hub", "small"):  # lanes follow one another
        spans = [ends[x] for x in sorted(ends) if x[0] == k]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_or_join_counts_equal_brute_force(spark):
    rows = random_rows(5, 90)
    for heat in (DEFAULT_HEAT, EAGER):
        got = {
            r.id: r.matched_rows
            for r in joins.or_theta_counts(with_clock(make_ledger(spark, rows)), heat).collect()
        }
        for i, amount, s, r, _, _, us in rows:
            hits = 0
            for j, a2, s2, r2, _, _, us2 in rows:
                if j == i or us2 >= us:
                    continue
                own = s is not None and s2 == s
                hits += (
                    (r2 == r and us2 >= us - 3 * DAY)
                    or (own and a2 == amount and us2 >= us - 2 * DAY)
                    or (own and us2 >= us - HOUR)
                )
            assert got[i] == hits, i


@pytest.mark.parametrize("heat", [DEFAULT_HEAT, EAGER], ids=["ordinary", "hot"])
def test_lag_and_latest_mark(spark, heat):
    rows = random_rows(13)
    t = with_clock(make_ledger(spark, rows)).select("id", "us", SENDER, "amount")
    lagged = {r.id: r.previous for r in windows.lag_by_key(t, SENDER, heat).collect()}
    marked = windows.latest_mark(t, SENDER, F.col("amount") == 20, "mark", heat)
    marks = {r.id: r.mark for r in marked.collect()}
    zero = t.agg(F.min("us")).first()[0] - min(r[6] for r in rows)
    for i, _, s, _, _, _, us in rows:
        mine = sorted((o[6], o[0]) for o in rows if s is not None and o[2] == s)
        before = [m for m in mine if m < (us, i)]
        want = before[-1] if before else None
        got = lagged[i]
        assert (None if got is None else (got.us - zero, got.id)) == want
        at = [o[6] for o in rows if s is not None and o[2] == s and o[1] == 20 and o[6] <= us]
        assert (None if marks[i] is None else marks[i] - zero) == (max(at) if at else None)


def test_ordinary_plan_has_two_shuffles(spark, capsys):
    rows = [("t1", 1, "a", "x", None, None, 0), ("t2", 2, "b", "x", None, None, 5)]
    fraud_features(make_ledger(spark, rows), make_accounts(spark, ["a"])).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 4  # two, plus a sort-merge join's sides
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_previous(spark):
    rows = random_rows(17, 60)
    out = joins.previous_of_sender(ledger_rows(make_ledger(spark, rows)), EAGER).collect()
    for r in out:
        mine = [o for o in rows if r[SENDER] is not None and o[2] == r[SENDER]]
        me = next(o for o in rows if o[0] == r.id)
        before = [(o[6], o[0]) for o in mine if o[6] < me[6]]
        assert (r.previous.id if r.previous else None) == (max(before)[1] if before else None)


def test_lookup_types(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 9)], "id long, k long")
    dim = spark.createDataFrame([(5, "five")], "key long, name string")
    for heat in (DEFAULT_HEAT, Heat(min_rows=2, max_keys=3, lane_rows=1)):
        got = {r.id: r.name for r in lookup(left, dim, "k", "key", heat).collect()}
        assert got == {1: "five", 2: None, 3: "five", 4: None}


def test_sender_history_null_sender(spark):
    rows = [("n1", 1, None, "x", None, None, 0), ("n2", 1, None, "x", None, None, 5)]
    out = sender_history(ledger_rows(make_ledger(spark, rows))).collect()
    assert all(r.previous is None and r.sender_txn_count_last_1h == 0 for r in out)
