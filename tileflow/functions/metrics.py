"""Summaries of measurement logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.operators.order import numbered


def means(metrics: DataFrame, doubled: Sequence[str] = ()) -> DataFrame:
    """tag, mean, n of (tag, value); tags in doubled count twice."""
    factor = F.when(F.col("tag").isin(list(doubled)), 2.0).otherwise(1.0) if doubled else F.lit(1.0)
    return metrics.groupBy("tag").agg((F.avg("value") * F.first(factor)).alias("mean"), F.count("value").alias("n"))


def wide(metrics: DataFrame, tags: Sequence[str], totals: dict[str, Sequence[str]] | None = None, by: str = "run") -> DataFrame:
    """A row for each run with the mean of each tag in a column, and sums of tags as further columns."""
    table = metrics.groupBy(by).pivot("tag", list(tags)).agg(F.avg("value"))
    return table.withColumns({name: sum((F.coalesce(F.col(t), F.lit(0.0)) for t in parts), F.lit(0.0)) for name, parts in (totals or {}).items()})


def rescaled(table: DataFrame, column: str, batch: int, more: float = 1.0) -> DataFrame:
    """A set-up time as a run bears it: divided by the batch's runs, and so many seconds more."""
    if batch < 1:
        raise ValueError("batch is below 1")
    return table.withColumn(column, F.col(column) / batch + more)


def amortised(table: DataFrame, with_setup: str, without_setup: str, batch: int) -> DataFrame:
    """Adds `amortised`: a setup's cost for each of the batch's runs."""
    if batch < 1:
        raise ValueError("batch is below 1")
    return table.withColumn("amortised", (F.col(with_setup) - F.col(without_setup)) / batch)


def by_traffic(interfaces: DataFrame) -> DataFrame:
    """Interface statistics with their position, the most downloaded first, then by name."""
    down = interfaces.withColumn("descending_", -F.col("download"))
    return numbered(down, ["descending_", "interface"], "position").drop("descending_")
