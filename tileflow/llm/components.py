"""Connected components of links, by the star steps of plans.components on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import materialise, remove
from tileflow.plans.components import stars


def _remove(spark: SparkSession, table: DataFrame) -> None:
    remove(spark, *{f.rpartition("/")[0] for f in table.inputFiles()})


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u long, v long) that isn't its component's smallest; component is that smallest."""
    return stars(edges, lambda df: materialise(spark, df, "edges"), lambda df: _remove(spark, df))


def same_ids(rows: DataFrame) -> DataFrame:
    """Links (u, v) between the classes (c) that share an id: rows (id, c) with one id are one node, whatever their classes."""
    least = rows.where("id IS NOT NULL AND c IS NOT NULL").groupBy("id").agg(F.min("c").alias("u"), F.max("c").alias("last")).where("u < last").select("id", "u")
    return rows.select("id", F.col("c").alias("v")).join(least, "id").where("v <> u").select("u", "v").distinct()


def with_components(spark: SparkSession, rows: DataFrame, component: DataFrame) -> DataFrame:
    """rows (id, c, ...) with component_id, the smallest id of what is connected with a row's class; component: (node, component) of classes.

    A row without a class has the component of the rows with its id, or its id; one without an id has null.
    """
    nodes = rows.where("id IS NOT NULL AND c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    rooted = materialise(spark, nodes.join(component, F.col("c") == F.col("node"), "left").select("c", F.coalesce("component", "c").alias("root"), "least"), "roots")
    smallest = materialise(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")  # written: a join with it can be split
    of_class = materialise(spark, rooted.join(smallest, "root").select("c", "component_id"), "components")
    _remove(spark, rooted)
    _remove(spark, smallest)
    classed = rows.where("c IS NOT NULL").join(of_class, "c", "left")
    alone = rows.where("c IS NULL AND id IS NOT NULL")
    of_id = classed.where("id IS NOT NULL").join(alone.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("component_id"))
    columns = [*rows.columns, "component_id"]
    found = classed.select(*rows.columns, F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    rest = alone.join(of_id, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")).select(columns)
    nobody = rows.where("c IS NULL AND id IS NULL").withColumn("component_id", F.lit(None).cast("long")).select(columns)
    return found.unionByName(rest).unionByName(nobody)
