"""A request's fourteen features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import clamp, d, instant, quantize_vector, risk, round4


def _features(t: dict[str, Column], fallback: float) -> list[Column]:
    hour, day, gap = t["hour"], t["weekday"], t["minutes_since_last"]
    return [
        clamp(t["amount"] / d(10000)),
        clamp(t["installments"] / d(12)),
        F.when(t["customer_avg"] > 0, clamp((t["amount"] / t["customer_avg"]) / d(10))).otherwise(d(fallback)),
        hour / d(23),
        day / d(6),
        F.when(t["has_last"], clamp(gap / d(1440))).otherwise(d(-1)),
        F.when(t["has_last"], clamp(t["km_since_last"] / d(1000))).otherwise(d(-1)),
        clamp(t["km_from_home"] / d(1000)),
        clamp(t["tx_count_24h"] / d(20)),
        t["is_online"].cast("double"),
        t["card_present"].cast("double"),
        F.when(t["merchant_known"], d(0)).otherwise(d(1)),
        risk(t["mcc"]),
        clamp(t["merchant_avg"] / d(10000)),
    ]


def request_features(r: Column) -> list[Column]:
    """f0 to f13 of a request struct (schema.REQUEST), rounded to four decimals. What a request lacks makes features null."""
    at, last = instant(r["transaction"]["requested_at"]), r["last_transaction"]
    t = {
        "amount": r["transaction"]["amount"],
        "installments": r["transaction"]["installments"],
        "customer_avg": r["customer"]["avg_amount"],
        "hour": F.hour(at),
        "weekday": F.weekday(at),
        "has_last": last.isNotNull(),
        "minutes_since_last": (F.unix_timestamp(at) - F.unix_timestamp(instant(last["timestamp"]))) / d(60),
        "km_since_last": last["km_from_current"],
        "km_from_home": r["terminal"]["km_from_home"],
        "tx_count_24h": r["customer"]["tx_count_24h"],
        "is_online": r["terminal"]["is_online"],
        "card_present": r["terminal"]["card_present"],
        "merchant_known": F.array_contains(r["customer"]["known_merchants"], r["merchant"]["id"]),
        "mcc": r["merchant"]["mcc"],
        "merchant_avg": r["merchant"]["avg_amount"],
    }
    return [round4(x) for x in _features(t, 1.0)]


def typed_features(df: DataFrame) -> list[Column]:
    """f0 to f13 of flat, typed transactions: a customer without an average counts a half, and the last transaction is absent if its second is not positive."""
    t = {c: df[c] for c in df.columns}
    t["has_last"] = t["last_tx_seconds"] > 0
    return [round4(x) for x in _features(t, 0.5)]


def is_valid(r: Column) -> Column:
    """Whether a parsed request has all that the features need; an absent last transaction is fine."""
    needed = [
        r["transaction"]["amount"], r["transaction"]["installments"], instant(r["transaction"]["requested_at"]), r["customer"]["avg_amount"], r["customer"]["tx_count_24h"],
        r["customer"]["known_merchants"], r["merchant"]["id"], r["merchant"]["mcc"], r["merchant"]["avg_amount"], r["terminal"]["is_online"], r["terminal"]["card_present"], r["terminal"]["km_from_home"],
    ]
    ok = r.isNotNull()
    for x in needed:
        ok = ok & x.isNotNull()
    last = r["last_transaction"]
    return ok & (last.isNull() | (instant(last["timestamp"]).isNotNull() & last["km_from_current"].isNotNull()))


def vector(features: list[Column]) -> Column:
    """The quantised features as an int array. By one small expression for all of them: fourteen written out are a method too large for the JVM to compile."""
    return quantize_vector(F.array(*features))
