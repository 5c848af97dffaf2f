"""Running sums over a whole table without a window that puts it into one task.

Rows are dealt to ranges of the order (``RANGE_ROWS`` rows each or so, by quantiles that are fixed before), every range is summed, and a row's running sum is what its range begins
with, plus a sum inside the range.  The driver holds one row for each range; a range is found by binary search in the literal list of bounds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 20


def range_bounds(df: DataFrame, order: tuple[str, ...], ranges: int) -> list[tuple]:
    """The first key of each range but the first."""
    if ranges < 2:
        return []
    dealt = df.select(*order).repartitionByRange(ranges, *order)
    firsts = dealt.groupBy(F.spark_partition_id().alias("k")).agg(F.min(F.struct(*order)).alias("low")).orderBy("low").collect()
    return [tuple(r["low"]) for r in firsts[1:]]


def range_of(df: DataFrame, order: tuple[str, ...], bounds: list[tuple]) -> Column:
    """How many of the bounds are at or under a row's key (nulls come first)."""
    if not bounds:
        return F.lit(0)
    kinds = dict(df.dtypes)
    listed = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, low)]) for low in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    key = F.struct(*order)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= key, at + step).otherwise(at))


def running_sums(df: DataFrame, values: Mapping[str, Column], order: tuple[str, ...], range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns, and for each of ``values`` under its name the sum of it over the rows before, in ``order`` (which must tell all rows apart); a null counts as 0."""
    parts = {name: F.coalesce(value.cast("long"), F.lit(0).cast("long")) for name, value in values.items()}
    bounds = range_bounds(df, order, max(2, -(-df.count() // range_rows)))
    keyed = df.withColumns({f"__{name}": value for name, value in parts.items()}).withColumn("__range", range_of(df, order, bounds))
    of_range = {r["__range"]: r for r in keyed.groupBy("__range").agg(*[F.sum(f"__{name}").alias(name) for name in parts]).collect()}
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name in parts:
        begins, total = [], 0
        for k in range(len(bounds) + 1):
            begins.append(total)
            total += of_range[k][name] if k in of_range else 0
        begin = F.get(F.array(*[F.lit(b).cast("long") for b in begins]), F.col("__range")) if bounds else F.lit(0).cast("long")
        out[name] = begin + F.coalesce(F.sum(f"__{name}").over(inside), F.lit(0).cast("long"))
    return keyed.withColumns(out).drop("__range", *[f"__{name}" for name in parts])
