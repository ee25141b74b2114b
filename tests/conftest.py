import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwatch.operators.hotkeys import Heat  # noqa: E402
from tillwatch.session import local_session  # noqa: E402

TINY = "/root/testdata/sf0.001"

# Every key with three rows is hot, in lanes of about two rows.
EAGER = Heat(min_rows=3, max_keys=50, lane_rows=2)

TX_SCHEMA = (
    "id string, amount decimal(18,2), sender_account_id string, receiver_account_id string, "
    "latitude string, longitude string, is_fraud boolean, fraud_type string, created_at timestamp"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(us: int) -> datetime.datetime:
    return EPOCH + datetime.timedelta(microseconds=us)


def make_ledger(spark, rows):
    """rows: (id, amount, sender, receiver, lat, lon, micros after 2024-01-01)."""
    from decimal import Decimal

    data = [
        (i, Decimal(str(a)), s, r, lat, lon, False, None, at(us)) for i, a, s, r, lat, lon, us in rows
    ]
    return spark.createDataFrame(data, TX_SCHEMA)


def make_accounts(spark, ids, opened_us=-3_600_000_000):
    rows = [(i, f"10{n:04d}", at(opened_us)) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, account_number string, created_at timestamp")
