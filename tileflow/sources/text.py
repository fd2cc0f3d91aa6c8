"""Readers of the text formats: edge lists, partition maps, ratings, comma-separated edges, measurement logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.errors import DuplicateKey, FormatError, OutOfRange
from tileflow.operators.order import numbered


def effective_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't empty and don't begin with #."""
    return spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _number(fields: Column, k: int, kind: str = "long") -> Column:
    return F.try_element_at(fields, F.lit(k)).try_cast(kind)


def _reject(df: DataFrame, bad: Column, error: type[Exception], what: str, show: str) -> None:
    if (first := df.where(bad).select(show).first()) is not None:
        raise error(f"{what}: {first[0]!r}")


def read_edges(spark: SparkSession, path: str, default_weight: int = 1, undirected: bool = False, strict: bool = True) -> DataFrame:
    """src, dst, weight of `src dst [weight]` lines; further fields are ignored. strict: a line that can't be read raises, else it is left out."""
    f = _fields(F.col("value"))
    read = effective_lines(spark, path).select("value", _number(f, 1).alias("src"), _number(f, 2).alias("dst"), F.when(F.size(f) >= 3, _number(f, 3)).otherwise(F.lit(default_weight).cast("long")).alias("weight"))
    bad = F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull() | (F.col("src") < 0) | (F.col("dst") < 0)
    if strict:
        _reject(read, bad, FormatError, "not an edge", "value")
    edges = read.where(~bad).select("src", "dst", "weight")
    return reversed_too(edges) if undirected else edges


def reversed_too(edges: DataFrame) -> DataFrame:
    """edges and each of them reversed; a self-loop is there twice."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def read_partition(spark: SparkSession, path: str, tiles: int, merge: int = 1) -> DataFrame:
    """vid, tile of `vid tile` lines; merge neighbouring tiles are one. A repeated vid or a tile outside raises."""
    f = _fields(F.col("value"))
    read = effective_lines(spark, path).select("value", _number(f, 1).alias("vid"), F.floor(_number(f, 2) / merge).cast("int").alias("tile"))
    _reject(read, F.col("vid").isNull() | F.col("tile").isNull(), FormatError, "not a vertex and its tile", "value")
    _reject(read, (F.col("tile") >= tiles) | (F.col("tile") < 0), OutOfRange, f"not one of {tiles} tiles", "value")
    _reject(read.groupBy("vid").count(), F.col("count") > 1, DuplicateKey, "a vertex with two lines", "vid")
    return read.select("vid", "tile")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user, movie, rating of tab-separated lines with three fields."""
    f = F.split(F.col("value"), "\t")
    read = effective_lines(spark, path).select("value", F.size(f).alias("n"), _number(f, 1).alias("user"), _number(f, 2).alias("movie"), _number(f, 3, "double").alias("rating"))
    _reject(read, (F.col("n") != 3) | F.col("user").isNull() | F.col("movie").isNull() | F.col("rating").isNull(), FormatError, "not a rating", "value")
    return read.select("user", "movie", "rating")


def read_csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst: the first two fields of comma-separated lines that aren't empty."""
    f = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path).select(_number(f, 1).alias("src"), _number(f, 2).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def read_metrics(spark: SparkSession, path: str, marker: str = "::") -> DataFrame:
    """tag, value of `<marker>tag value` lines; a byte-order mark before the first is no part of it."""
    line = F.regexp_replace("value", "^\\uFEFF", "")
    pattern = rf"^{marker}(\S+)\s+([-+0-9.eE]+)"
    return spark.read.text(path).select(F.regexp_extract(line, pattern, 1).alias("tag"), F.regexp_extract(line, pattern, 2).try_cast("double").alias("value")).where("tag <> '' AND value IS NOT NULL")


def read_sections(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """section, position, cells of a table file: a line `>>>> name` begins a section, the others are rows of cells.

    A file is one record, so that rows keep their section; such files are written by hand and small.
    """
    text = spark.read.text(path, wholetext=True)
    section = F.explode(F.slice(F.split("value", r"(?m)^>>>>\s*"), 2, 1 << 30))
    rows = text.select(section.alias("part")).select(F.trim(F.split("part", "\n")[0]).alias("section"), F.posexplode(F.slice(F.split("part", "\n"), 2, 1 << 30)).alias("position", "line")).where("trim(line) <> ''")
    cells = F.transform(F.split(F.trim(F.trim("line"), F.lit(separator)), f"\\{separator}"), lambda x: F.trim(x))
    return rows.select("section", "position", cells.alias("cells"))


def dense_ratings(ratings: DataFrame) -> DataFrame:
    """ratings (user, movie, rating) with user_index and movie_index: 0, 1, ... by id."""
    for kind in ("user", "movie"):
        index = numbered(ratings.select(kind).distinct(), [kind], f"{kind}_index")
        ratings = ratings.join(index, kind)
    return ratings.select("user", "movie", "rating", "user_index", "movie_index")
