"""Column expressions of the scoring pipeline; all stay inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import APPROVED_BELOW, DEFAULT_RISK, DIM, RISK, SCALE, SENTINEL


def d(x) -> Column:
    return F.lit(x).cast("double")


def clamp(x: Column) -> Column:
    """x, but no less than 0 and no more than 1."""
    return F.least(F.greatest(x, d(0)), d(1))


def round4(x: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(x * SCALE) / SCALE


def quantize(x: Column) -> Column:
    """A whole number of 1/SCALE, at most SCALE; below zero the sentinel."""
    return F.when(x < 0, F.lit(SENTINEL)).otherwise(F.round(F.least(x, d(1)) * SCALE)).cast("int")


def quantize_vector(v: Column) -> Column:
    return F.transform(v, quantize)


def squared_distance(a: Column, b: Column, dims: int = DIM) -> Column:
    """Squared Euclidean distance of two int arrays as a long, unrolled over the dimensions."""
    parts = [(F.get(a, k).cast("long") - F.get(b, k)) for k in map(F.lit, range(dims))]
    return reduce(add, [p * p for p in parts])


def box_lower_bound(q: Column, lo: Column, hi: Column, dims: int = DIM) -> Column:
    """The least squared distance from q to any point of the box, as a long."""
    gaps = [F.greatest(F.get(lo, k).cast("long") - F.get(q, k), F.get(q, k).cast("long") - F.get(hi, k), F.lit(0).cast("long")) for k in map(F.lit, range(dims))]
    return reduce(add, [g * g for g in gaps])


def encode_label(label: Column) -> Column:
    """1 for fraud, else 0; null for null."""
    return (label == "fraud").cast("int")


def risk(mcc: Column) -> Column:
    """A category's risk; unknown and null categories have the default. Ten literals, so a branch is cheaper than a join."""
    found = reduce(lambda e, kv: e.when(mcc == kv[0], d(kv[1])), list(RISK.items())[1:], F.when(mcc == next(iter(RISK)), d(next(iter(RISK.values())))))
    return found.otherwise(d(DEFAULT_RISK))


def instant(text: Column) -> Column:
    """A timestamp from yyyy-MM-ddTHH:mm:ss; what follows is ignored, what doesn't parse is null. The session's time zone is UTC."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def approved(votes: Column) -> Column:
    return votes < APPROVED_BELOW


def fraud_score(votes: Column) -> Column:
    """Fifths, of five votes at most."""
    return F.least(votes, F.lit(5)) / d(5)


def verdict_json(votes: Column) -> Column:
    return F.to_json(F.struct(approved(votes).alias("approved"), fraud_score(votes).alias("fraud_score")))


def split_trim(text: Column) -> Column:
    """The parts between commas without the blanks around them; empty ones go."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
