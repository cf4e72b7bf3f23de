"""Exact ranks and quantiles of whole columns: no window or buffer ever holds a column in one task.

Values are counted, the counts dealt to tasks by range, and sums per range (a
row each) put before the sums inside the ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.aqi import clean
from skysieve.operators.scratch import keep


def cumulative(rows: DataFrame, order: str, count: str, by: list[str] | None = None) -> DataFrame:
    """Adds upto: the sum of ``count`` up to and with the row, in ascending order of ``order``, in all or by group. Rows must differ in (by, order)."""
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_part").agg(F.sum(count).alias("_s"))
    before = sums.select(*by, "_part", (F.sum("_s").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_s")).alias("_before"))
    inside = F.sum(count).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(before, [*by, "_part"]).withColumn("upto", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


#: Values that one buffer may hold; longer columns are ranked by range.
ONE_BUFFER = 1_000_000


def quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float | None]:
    """The column's exact quantiles, linear between neighbours; nulls and NaN left out, all null where nothing is left.

    Up to ``ONE_BUFFER`` values meet in one buffer; both ways give the same numbers.
    """
    known = df.select(clean(F.col(value)).alias("x")).filter("x IS NOT NULL")
    if known.count() <= ONE_BUFFER:
        return list(known.agg(F.percentile("x", F.array(*(F.lit(float(q)) for q in probs)))).first()[0] or [None] * len(probs))
    return _by_range(df, value, probs)


def _by_range(df: DataFrame, value: str, probs: list[float]) -> list[float | None]:
    counts = df.select(clean(F.col(value)).alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    ranked = cumulative(counts, "x", "c")
    n = ranked.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(probs)
    at = [q * (n - 1) for q in probs]
    ends = [(math.floor(p), math.ceil(p)) for p in at]
    found = ranked.agg(*(F.min(F.when(F.col("upto") > r, F.col("x"))).alias(f"q{k}_{e}") for k, pair in enumerate(ends) for e, r in enumerate(pair))).first()
    return [found[2 * k] + (found[2 * k + 1] - found[2 * k]) * (p - lo) for k, (p, (lo, _)) in enumerate(zip(at, ends, strict=True))]
