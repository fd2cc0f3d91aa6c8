"""Places in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tileflow.plans.lineage import cut


def numbered(df: DataFrame, order: Sequence[str], name: str, group: Sequence[str] = ()) -> DataFrame:
    """df with a column `name`: 0, 1, ... by the columns of order, from the start for each group.

    Rows are dealt into ranges of (group, order) by sampled bounds and kept there by a checkpoint; a place is the size
    of the group's earlier ranges, a count each, and the place within the range. Group by few or many columns alike: no
    range is larger than the others but by rows that are equal in all columns named. Nulls are a group, and come first in
    an order. The starts of groups that run over into further ranges, a row a range at most, are broadcast.
    """
    return _accumulated(df, order, name, group, None)


def accumulated(df: DataFrame, order: Sequence[str], value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """df with a column `name`: the sum of value (0 or more, not null) over the rows before this one by the columns of order, in the
    same way as numbered() counts them. Rows equal in all columns of order follow each other in any order."""
    return _accumulated(df, order, name, group, value)


def _accumulated(df: DataFrame, order: Sequence[str], name: str, group: Sequence[str], value: str | None) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_, own, start, size = (_free(df, x) for x in ("range_", "own_", "start_", "size_"))
    ranged = cut(df.repartitionByRange(n, *group, *order).withColumn(range_, F.spark_partition_id()))
    sizes = ranged.groupBy(*group, range_).agg((F.count("*") if value is None else F.sum(value)).alias(size))
    before = Window.partitionBy(*group).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    # a range begins in the midst of one group at most, so there are no more starts than ranges
    starts = sizes.withColumn(start, F.sum(size).over(before)).where(F.col(start) > 0).select(*[F.col(g).alias(f"{g}{start}") for g in group], F.col(range_).alias(f"{range_}{start}"), start)
    inside = Window.partitionBy(*group, range_).orderBy(*order)
    mine = F.row_number().over(inside) - 1 if value is None else F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ranged.withColumn(own, mine)
    same = F.col(range_) == F.col(f"{range_}{start}")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}{start}"))
    placed = counted.join(F.broadcast(starts), same, "left")
    total = F.col(own) + F.coalesce(start, F.lit(0))
    return placed.withColumn(name, total.cast("long") if value is None else total).select(*df.columns, name)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
