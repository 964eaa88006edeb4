"""What an order of all rows would tell - values at ranks, numbers, running totals - without one task that gets all rows.

Quantile sketches, merged in two steps, bracket a rank; Spark's range partitions, whose bounds come
from a sample, number rows: their sizes follow the rows, not the values, so outliers and hot keys don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a range, about.
RANGE_ROWS = 1_000_000
#: Different values that one step brings to the driver.
FEW = 50_000
#: The accuracy of sketches: ranks are off by a few ten-thousandths of the rows. Partial ones are merged in so many groups first.
SKETCH_K, MERGES = 8_192, 64
#: A bracket reaches so far on either side of its rank, in shares of the rows.
MARGIN = 0.002
#: What a bracket leaves out on either side.
_BELOW, _WITHIN = 0, 1


def _kind(rows: DataFrame, column: str) -> str:
    return "double" if dict(rows.dtypes)[column] in ("double", "float") or dict(rows.dtypes)[column].startswith("decimal") else "bigint"


def _sketch(rows: DataFrame, column: str, kind: str) -> tuple[bytes | None, int]:
    """A quantile sketch of the values, and their number."""
    add, merge = (getattr(F, f"kll_{x}_agg_{kind}") for x in ("sketch", "merge"))
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("g")).agg(add(F.col(column).cast(kind), F.lit(SKETCH_K)).alias("s"), F.count(F.lit(1)).alias("n"))
    found = parts.agg(merge("s").alias("s"), F.sum("n").alias("n")).first()
    return found["s"], found["n"] or 0


def _bracket(rows: DataFrame, column: str, kind: str, sketch: bytes, low: float, high: float) -> tuple:
    """The sketch's values at two shares of the rows; nothing where a share is at an end."""
    at = getattr(F, f"kll_sketch_get_quantile_{kind}")
    held = F.lit(sketch)
    got = rows.sparkSession.range(1).select(*[at(held, F.lit(min(max(x, 0.0), 1.0))).alias(c) for x, c in ((low, "a"), (high, "b"))]).first()
    return (got["a"] if low > 0 else None), (got["b"] if high < 1 else None)


def values_at_ranks(rows: DataFrame, column: str, first: int, last: int | None = None) -> list:
    """The values at ranks first to last, from 0 and FEW apart at most, of the non-null values in Spark's order, in which NaN comes after infinity; None for ranks beyond the values.

    Two passes: a sketch brackets the ranks, then one aggregation counts what lies below the bracket
    and each value within, however many ties it has. If more than FEW different values come before
    the ranks are reached, the rest of the bracket is sketched and counted in the same way; each
    round leaves a small share of the rows or ends.
    """
    last = first if last is None else last
    present = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    floating = dict(present.dtypes)["x"] in ("double", "float")
    found: dict[int, object] = {}
    before, low, under, total = 0, None, None, None  # values at or below low are done with, and so many; those from under on aren't sought
    kind = _kind(present, "x")
    numbers = present.where(~F.isnan("x")) if floating else present
    while len(found) <= last - first:
        within = numbers
        if low is not None:
            within = within.where(F.col("x") > F.lit(low))
        if under is not None:
            within = within.where(F.col("x") < F.lit(under))
        sketch, n = _sketch(within, "x", kind)
        total = n if total is None else total
        if not n:
            if under is None:
                break
            under = None  # the ranks lie above
            continue
        left = lambda rank, off: (rank - before) / n + off  # noqa: E731, B023
        lo, hi = _bracket(within, "x", kind, sketch, left(first + len(found), -MARGIN), left(last, MARGIN))
        side = F.when(F.col("x") < F.lit(lo), F.lit(_BELOW)).otherwise(F.lit(_WITHIN)) if lo is not None else F.lit(_WITHIN)
        top = within if hi is None else within.where(F.col("x") <= F.lit(hi))
        counted = top.groupBy(side.alias("side"), F.when(side == _WITHIN, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        held = counted.orderBy("side", "x").limit(FEW).collect()
        if held and held[0]["side"] == _BELOW and before + held[0]["n"] > first + len(found):
            under = lo  # the sketch was too far up: look below its bracket, which leaves fewer rows
            continue
        for r in held:
            before += r["n"]
            while len(found) <= last - first and first + len(found) < before:
                found[len(found)] = r["x"]
            low = r["x"] if r["side"] == _WITHIN else low
        if len(held) < FEW:  # all of the bracket is counted
            if hi is None:
                low = low if low is not None else lo
                if under is None:
                    break
                under = None
            else:
                low = hi
    values = [found.get(k) for k in range(last - first + 1)]
    if floating and None in values:
        nans = present.count() - total
        for k, v in enumerate(values):
            if v is None and first + k < total + nans:
                values[k] = float("nan")
    return values


def value_at_rank(rows: DataFrame, column: str, rank: int):
    """The value at a rank, from 0, of the non-null values in order; None if there are not so many."""
    return values_at_ranks(rows, column, rank)[0]


def _coarse(x: Column) -> Column:
    """A number for each 64th of an octave, in order; zero, numbers below it, infinity and NaN have their own."""
    infinite, zero = F.lit(float("inf")), F.lit(0.0)
    special = F.when(F.isnan(x), 1 << 20).when(x == infinite, 1 << 19).when(x == -infinite, -(1 << 20)).when(x < zero, -(1 << 19)).when(x == zero, -(1 << 18))
    return special.otherwise(F.floor(F.log2(x) * 64).cast("int"))


def values_at_totals(counts: DataFrame, value: str, weight: str, ranks: list[int]) -> list[float | None]:
    """The values at ranks, from 0, of doubles of which each row stands for ``weight`` equal ones; None beyond them all.

    One aggregation counts by coarse steps of the value; then a rank's step is cut into a thousand and
    counted again, until it holds one value. Each time the least and the greatest value part, so this ends.
    """
    rows = counts.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(F.col(value).cast("double").alias("x"), F.col(weight).alias("w"))

    def steps(part: DataFrame, key: Column) -> list:
        return part.groupBy(key.alias("k")).agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k").collect()

    top, found = steps(rows, _coarse(F.col("x"))), []
    for rank in ranks:
        held, left, at = top, rank, None
        while at is None:
            for step in held:
                if left < step["w"]:
                    break
                left -= step["w"]
            else:
                break
            lo, hi = step["lo"], step["hi"]
            if lo == hi or lo != lo:
                at = lo
            else:  # halves, as the difference of two doubles may be none
                x, low, high = F.col("x") / 2, lo / 2, hi / 2
                share = F.when(F.col("x") == F.lit(hi), F.lit(999)).otherwise(F.least(F.floor((x - low) / F.lit(high - low) * 999), F.lit(998)).cast("int"))
                held = steps(rows.where((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi))), share)
        found.append(at)
    return found


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, stored in order, with ``__part``, a range of the order, and ``__at``, the row's number from 0 in it.

    There is a range for about RANGE_ROWS rows. Their bounds come from a sample of the rows, so they
    are even whatever the values are; equal values share a range.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered_ = sorted_.withColumn("__id", F.monotonically_increasing_id())
    return stored(numbered_.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))


def at_total(rows: DataFrame, order: str, weight: Column, target: float) -> DataFrame | None:
    """The rows of the range of ``order`` in which the running total of weight reaches target, with ``before``, what comes ahead of the range; None if it is never reached. A null weight is none."""
    held = ordered(rows.withColumn("__w", weight), order)
    before = 0
    for r in held.groupBy("__part").agg(F.sum("__w").alias("w")).orderBy("__part").collect():  # a row for RANGE_ROWS rows
        if before + (r["w"] or 0) >= target:
            return held.where(F.col("__part") == r["__part"]).drop("__part", "__at", "__w").withColumn("before", F.lit(before))
        before += r["w"] or 0
    return None


def numbered(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """rows with ``place``, their number from 0 by ``order`` among the rows of equal ``by``.

    Rows lie in ranges of (by, order), and a row's number there is known from the sort. What is added
    is where its group starts in the range and how many of the group the ranges before hold: a row
    for each range and group. Values of ``order`` must be unique within a group.
    """
    held = ordered(rows, *by, order)
    starts = held.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    added = starts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    on = F.lit(True)
    for c in (*by, "__part"):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = held.alias("a").join(added.alias("b"), on)
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a.__at") - F.col("b.__first") + F.col("b.__ahead")).cast("long").alias("place"))
