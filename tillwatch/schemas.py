"""Declared schemas; nothing in the package infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

TRANSACTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("sender_account_id", T.StringType()),
        T.StructField("receiver_account_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ACCOUNT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("account_number", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("balance", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def change_row(table: T.StructType) -> T.StructType:
    """The row image inside a change event: times travel as epoch milliseconds."""
    return T.StructType(
        [
            T.StructField(
                f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType
            )
            for f in table.fields
        ]
    )


def change_event(table: T.StructType) -> T.StructType:
    row = change_row(table)
    return T.StructType(
        [
            T.StructField("before", row),
            T.StructField("after", row),
            T.StructField("op", T.StringType()),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("ts_us", T.LongType()),
            T.StructField("ts_ns", T.LongType()),
        ]
    )


# The nine numeric profile columns, in model order.
PROFILE = [
    "trans_amount",
    "age_hours_open_acc",
    "receiver_txn_count_last_3d",
    "unique_senders_last_3d",
    "multi_same_amt_count_2d",
    "sender_txn_count_last_1h",
    "sender_volume_last_1h",
    "days_since_last_trans",
    "geo_speed_kmh",
]

DERIVED = [
    "is_new_account_no_history",
    "trans_amount_log",
    "sender_volume_last_1h_log",
    "avg_amt_per_txn_last_1h",
]

COUNT_COLUMNS = {
    "receiver_txn_count_last_3d",
    "unique_senders_last_3d",
    "multi_same_amt_count_2d",
    "sender_txn_count_last_1h",
}

FEATURE_ROW = T.StructType(
    [T.StructField("transaction_id", T.StringType())]
    + [
        T.StructField(c, T.LongType() if c in COUNT_COLUMNS else T.DoubleType())
        for c in PROFILE
    ]
    + [T.StructField("is_fraud", T.BooleanType()), T.StructField("fraud_type", T.StringType())]
)

# The six labelled fraud scenarios.
FRAUD_TYPES = [
    "IMMEDIATE_LARGE_TRANSFER",
    "MANY_TO_ONE_CONSOLIDATION",
    "MULTIPLE_SAME_AMOUNT",
    "VELOCITY_SPIKE",
    "LOCATION_JUMP",
    "SLEEP_AND_WAKE",
]

# The ledger enums.
ACCOUNT_TYPES = ["SAVINGS", "CHECKING", "CREDIT", "LOAN"]
ACCOUNT_STATUSES = ["ACTIVE", "SUSPENDED", "CLOSED"]

PREDICTION_EVENT = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField(
            "prediction",
            T.StructType(
                [
                    T.StructField("transaction_id", T.StringType()),
                    T.StructField("sender_account_id", T.StringType()),
                    T.StructField("receiver_account_id", T.StringType()),
                    T.StructField("is_fraud", T.BooleanType()),
                    T.StructField("fraud_probability", T.DoubleType()),
                    T.StructField("fraud_type", T.StringType()),
                    T.StructField("model_version", T.StringType()),
                    T.StructField(
                        "features",
                        T.StructType(
                            [
                                T.StructField(
                                    c, T.LongType() if c in COUNT_COLUMNS else T.DoubleType()
                                )
                                for c in PROFILE
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
