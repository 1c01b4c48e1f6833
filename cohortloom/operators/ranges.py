"""Running values within groups of any size.

Rows are placed in ranges of (group, order), so that a group with a large share of all rows is spread over
many tasks. What a group had in earlier ranges is told by one row for each range it lies in; only
groups that lie in several ranges have such rows, so there are at most twice as many as ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize


def placed(df: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """df with its range in `_p`, written once so that the ranges stay the same."""
    by = [F.col(c) for c in (*group, *order)]
    spread = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return materialize(spread.withColumn("_p", F.spark_partition_id()))


def carried(rows: DataFrame, group: list[str], parts: dict[str, Column], carry: dict[str, Column], later: bool = False) -> DataFrame:
    """rows with what their group had in earlier (or later) ranges.

    parts: aggregates of a range's rows of a group; carry: aggregates of these over all earlier ranges,
    null for a group's first range.
    """
    own = rows.groupBy("_p", *group).agg(*[c.alias(n) for n, c in parts.items()])
    several = own.withColumn("_n", F.count("*").over(Window.partitionBy(*group))).where("_n > 1")
    window = Window.partitionBy(*group).orderBy(F.desc("_p") if later else F.asc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"_key_{c}" for c in ("_p", *group)}
    told = several.select(*[F.col(c).alias(k) for c, k in keys.items()], *[c.over(window).alias(n) for n, c in carry.items()])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return rows.join(F.broadcast(told), same, "left").drop(*keys.values())


def counted(rows: DataFrame, group: list[str], order: list[str], n: str | None = None) -> DataFrame:
    """rows (placed) with `_before`: rows of the group before each in the order, or the sum of a column over them."""
    size = F.col(n) if n else F.lit(1)
    window = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = carried(rows, group, {"_size": F.sum(size)}, {"_earlier": F.sum("_size")})
    return out.withColumn("_before", F.coalesce(F.sum(size).over(window), F.lit(0)) + F.coalesce("_earlier", F.lit(0))).drop("_earlier")
