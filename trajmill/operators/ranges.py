"""Ranks and running sums over a whole table without a window in one task.

Rows go to ranges whose splitters Spark samples from the rows, so outliers and skewed values make no large range, and a
range's rows are sorted in its task. Only the ranges' sums meet. `order` ends with a column that tells equal rows apart:
equal keys stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.sinks.tables import written

#: Rows of a range at which one more is made, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 1 << 18, 4096


def _count(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, min(MOST_RANGES, df.count() // RANGE_ROWS))


def in_ranges(df: DataFrame, order: list, ranges: int | None = None) -> DataFrame:
    """df, written, with __range and __place: the range and the place in it (from 0) of every row in `order`."""
    dealt = df.repartitionByRange(ranges or _count(df), *order).sortWithinPartitions(*order)
    numbered = written(dealt.withColumn("__id", F.monotonically_increasing_id()))  # the partition above 33 bits of the place
    return numbered.withColumns({"__range": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def _offsets(dealt: DataFrame, value: Column) -> DataFrame:
    """(__range, __before): the sum of `value` over the earlier ranges, of which there are MOST_RANGES at most."""
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))


def ranked_all(df: DataFrame, order: list, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with every row's place in `order`, from 0."""
    dealt = in_ranges(df, order, ranges)
    out = dealt.join(F.broadcast(_offsets(dealt, F.lit(1))), "__range")  # at most MOST_RANGES rows
    return out.withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def sum_before(df: DataFrame, order: list, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows before each in `order`."""
    dealt = in_ranges(df, order, ranges)
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("__in", F.coalesce(inside, F.lit(0))).join(F.broadcast(_offsets(dealt, F.col(value))), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__place", "__before", "__in")
