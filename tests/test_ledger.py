from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_accounts, make_ledger
from tillwatch.functions.predicates import order, where
from tillwatch.functions.text import plain_number
from tillwatch.operators import aggregates, ledger, maintenance, quality
from tillwatch.session import work_dir
from tillwatch.sources.manifest import LedgerStore


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 10), (2, "bob", None), (3, None, 30), (4, "BOBBY", 5)]
    return spark.createDataFrame(rows, "id int, name string, age int")


@pytest.mark.parametrize(
    "filters, ids",
    [
        ({"age": 10}, [1]),
        ({"age": None}, [2]),
        ({"age": {"not": None}}, [1, 3, 4]),
        ({"age": {"not": 10}}, [3, 4]),
        ({"age": {"notIn": [10, 30]}}, [4]),
        ({"age": {"in": []}}, []),
        ({"name": {"contains": "BOB", "mode": "insensitive"}}, [2, 4]),
        ({"name": {"startsWith": "b"}}, [2]),
        ({"OR": [{"age": {"gt": 20}}, {"name": {"endsWith": "n"}}]}, [1, 3]),
        ({"NOT": [{"age": {"lte": 5}}, {"name": "Ann"}]}, []),
        ({"AND": [{"age": {"gte": 5}}, {"age": {"lt": 30}}]}, [1, 4]),
    ],
)
def test_filters(people, filters, ids):
    assert sorted(r.id for r in people.where(where(filters)).collect()) == ids


def test_order_nulls(people):
    first = people.orderBy(*order([{"age": {"sort": "asc", "nulls": "first"}}])).first().id
    last = people.orderBy(*order([{"age": "desc"}])).collect()[-1].id
    assert first == 2 and last == 4


def test_plain_number(spark):
    df = spark.createDataFrame(
        [(Decimal("100.00"),), (Decimal("12.50"),), (Decimal("0.05"),)], "a decimal(18,2)"
    )
    assert [r[0] for r in df.select(plain_number(F.col("a"))).collect()] == ["100", "12.5", "0.05"]


@pytest.mark.parametrize("page, limit, want", [(0, 10, (1, 5, 0)), (3, 2, (3, 2, 4)), (-1, 0, (1, 1, 0))])
def test_page_bounds(page, limit, want):
    assert ledger.page_bounds(page, limit) == want


def test_empty_history_totals(spark):
    tx = make_ledger(spark, [("t", 1, "a", "b", None, None, 0)])
    own = spark.createDataFrame([], "id string")
    row = ledger.history_totals(tx, own).first()
    assert (row.total_count, row.total_pages, row.has_next_page) == (0, 1, False)


def test_kpis_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, created_at timestamp, is_fraud boolean, amount double")
    row = aggregates.monitoring_kpis(empty).first()
    assert (row.events, row.review_rate, row.volume) == (0, 0, 0)


def test_deletion_restrict_and_set_null(spark):
    acc = make_accounts(spark, ["a", "b", "c"])
    tx = make_ledger(spark, [("t1", 1, "a", "b", None, None, 0), ("t2", 1, "c", "b", None, None, 0)])
    left, rows = maintenance.delete_accounts(acc, tx, F.col("id").isin("a", "b"))
    assert sorted(r.id for r in left.collect()) == ["b", "c"]
    assert {r.id: r.sender_account_id for r in rows.collect()} == {"t1": None, "t2": "c"}


def test_request_reasons(spark):
    names = ["trans_amount", *quality.NON_NEGATIVE]
    good = [5.0] + [0.0] * 8
    rows = [good, [0.0] + good[1:], [5.0, None] + good[2:], [5.0, -1.0] + good[2:]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    reasons = [r.reasons for r in quality.check_requests(df).collect()]
    assert reasons == ["", "trans_amount:not_positive", "age_hours_open_acc:required", "age_hours_open_acc:negative"]


def test_request_defaults(spark):
    df = spark.createDataFrame([(None,)], "transaction_id string")
    row = quality.with_request_defaults(df).first()
    assert len(row.transaction_id) == 36 and row.sender_account_id == "unknown" and row.event_time


def test_user_deletion_is_one_statement(spark):
    acc = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v"), ("d", None)], "id string, user_id string")
    rows = [("1", 5, "a", "c", None, None, 0), ("2", 5, "c", "d", None, None, 1), ("3", 5, "b", "c", None, None, 2), ("4", 5, None, "c", None, None, 3)]
    tx = make_ledger(spark, rows)
    store = LedgerStore(spark, work_dir(spark, "store"), acc.schema, tx.schema)
    store.create(acc, tx)
    state = lambda v=None: ({r.id for r in store.read("accounts", v).collect()}, {r.id: r.sender_account_id for r in store.read("transactions", v).collect()})
    first = state()
    # c has received money: neither its user nor the other one of the same statement goes.
    assert not store.delete_users(F.col("user_id").isin("u", "v")) and state() == first and store.manifest.current() == 1
    assert store.delete_users(F.col("user_id") == "u")
    assert state() == ({"c", "d"}, {"1": None, "2": "c", "3": None, "4": None})
    assert state(1) == first  # a reader of the version before sees both tables as they were
    assert store.delete_received(F.col("user_id") == "v") and store.delete_users(F.col("user_id") == "v")
    assert state() == ({"d"}, {"2": None})
