"""Numbering of rows in the order of their groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with name: the row's place, from 1, among the rows of its group (not null) in that order, which must tell rows apart.

    Rows are dealt by ranges of group and order; each range numbers its own, and adds what earlier ranges have of the group: a table of
    groups in ranges.
    """
    return _counted(df, group, order, name, F.lit(1), 0).withColumn(name, F.col(name).cast("int"))


def started(df: DataFrame, group: str, order: list[str], size: str, name: str) -> DataFrame:
    """df with name: the sum of size over the rows of its group that stand before the row in that order; numbered on rows that stand for size others."""
    return _counted(df, group, order, name, F.col(size), -1)


def _counted(df: DataFrame, group: str, order: list[str], name: str, size: Column, end: int) -> DataFrame:
    part, place = f"__{name}_part", f"__{name}_place"
    ranged = df.repartitionByRange(group, *order).withColumn(part, F.spark_partition_id())
    rows = stage(ranged, "ranges")  # written once: the ranges are chosen from samples
    sizes = rows.groupBy(group, part).agg(F.sum(size).alias("__n"))
    upto = lambda w, last: w.rowsBetween(W.unboundedPreceding, last)
    before: Column = F.sum("__n").over(upto(W.partitionBy(group).orderBy(part), -1))
    sizes = sizes.select(group, part, F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(size).over(upto(W.partitionBy(group, part).orderBy(*order), end)), F.lit(0))
    return rows.withColumn(place, own).join(sizes, [group, part]).withColumn(name, F.col(place) + F.col("__before")).select(*[c for c in df.columns if c != name], name)
