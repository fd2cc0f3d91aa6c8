"""Writers of the text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a vertex without a path prints.
UNREACHED_TEXT = "Can not reach <- none"

def path_text(distance: Column, predecessor: Column) -> Column:
    """A path algorithm's payload. A vertex without a predecessor, the source too, prints as unreached."""
    reached = F.concat(distance.cast("string"), F.lit(" \t<- "), predecessor.cast("string"))
    return F.when(distance.isNull() | predecessor.isNull(), F.lit(UNREACHED_TEXT)).otherwise(reached)


def rank_text(rank: Column) -> Column:
    return rank.cast("string")


def vector_text(features: Column) -> Column:
    return F.array_join(F.transform(features, lambda x: x.cast("string")), " ")


def result_lines(vertices: DataFrame, payload: Column) -> DataFrame:
    """value (and tile if vertices has it): `id<TAB>payload`."""
    return vertices.select(*[c for c in ("tile",) if c in vertices.columns], F.concat_ws("\t", F.col("id").cast("string"), payload).alias("value"))


def write_results(vertices: DataFrame, payload: Column, path: str) -> None:
    """One folder for each tile, if there are tiles."""
    lines = result_lines(vertices, payload)
    out = lines.write.mode("overwrite")
    (out.partitionBy("tile") if "tile" in lines.columns else out).text(path)


def _lines(df: DataFrame, value: Column, header: str | None) -> DataFrame:
    """value, and before it (in a file of its own) a comment line if header is given."""
    lines = df.select(value.alias("value"))
    return lines if header is None else df.sparkSession.createDataFrame([(f"# {header}",), ("",)], "value string").coalesce(1).union(lines)


def write_edges(edges: DataFrame, path: str, separator: str = " ", header: str | None = None) -> None:
    """`src dst [weight]` lines."""
    columns = [c for c in ("src", "dst", "weight") if c in edges.columns]
    _lines(edges, F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]), header).write.mode("overwrite").text(path)


def write_partition(partition: DataFrame, path: str, header: str | None = None) -> None:
    """`vid<TAB>tile` lines."""
    _lines(partition, F.concat_ws("\t", F.col("vid").cast("string"), F.col("tile").cast("string")), header).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str, marker: str = "::") -> None:
    """`<marker>tag value` lines of (tag, value)."""
    metrics.select(F.concat(F.lit(marker), "tag", F.lit(" "), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)
