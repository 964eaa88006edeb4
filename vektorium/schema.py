"""Shapes and fixed values of the scoring service."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
DIM = 14
BLOCK_SIZE = 8
SCALE = 10_000
SENTINEL = -10_000
TOP_K = 5
CENTROIDS, SAMPLE_SIZE, ITERATIONS = 4096, 65_536, 6
FAST_PROBES, FULL_PROBES = 8, 32
BORDERLINE = (1, 4)
APPROVED_BELOW = 3
MAX_BODY = 4096

#: Of the stored index' layout.
INDEX_VERSION = 4

#: Merchant categories and their risk, fixed values; any other category has DEFAULT_RISK.
RISK = {
    "4511": 0.35,
    "5311": 0.25,
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "5999": 0.50,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
}
DEFAULT_RISK = 0.5

LABELLED = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])

REQUEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("transaction", T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("installments", T.IntegerType()), T.StructField("requested_at", T.StringType())])),
        T.StructField("customer", T.StructType([T.StructField("avg_amount", T.DoubleType()), T.StructField("tx_count_24h", T.IntegerType()), T.StructField("known_merchants", T.ArrayType(T.StringType()))])),
        T.StructField("merchant", T.StructType([T.StructField("id", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("avg_amount", T.DoubleType())])),
        T.StructField("terminal", T.StructType([T.StructField("is_online", T.BooleanType()), T.StructField("card_present", T.BooleanType()), T.StructField("km_from_home", T.DoubleType())])),
        T.StructField("last_transaction", T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("km_from_current", T.DoubleType())])),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("entries", T.ArrayType(T.StructType([T.StructField("request", REQUEST), T.StructField("expected_approved", T.BooleanType())]))),
        T.StructField("stats", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
