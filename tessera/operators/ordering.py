"""Running sums and places inside groups, without one task for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved, sized


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before in their group (0 for the first).

    Rows are dealt by ranges of group and order, so that a group with a third
    of all rows fills many tasks; what the ranges before hold of a group is
    added from a table with a row for each range and group.  Null groups are
    groups; the order should be total.
    """
    dealt = saved(rows.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range", *by).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(sums.withColumn("_before", F.sum("_sum").over(earlier)).select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_before"))
    same = F.col("_range") == F.col("_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = F.sum("_value").over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    joined = dealt.withColumn("_inside", inside).join(sized(before), same)
    return joined.withColumn(name, F.coalesce("_before", zero) + F.coalesce("_inside", zero)).drop("_value", "_range", "_at", "_before", "_inside", *[f"_by{k}" for k in range(len(by))])


def place(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in their group, from 0."""
    return running(rows, by, order, F.lit(1).cast("long"), name)
