"""What the operators share: shipping code, shared tables, per-worker caches."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tileflow.plans.lineage import shared_path

#: Rows in one Arrow batch: bounds a Python worker's memory when some texts are very long.
ARROW_ROWS = 256

#: Entries a per-worker cache holds before it is emptied.
CACHE_ENTRIES = 200_000


def ready(spark: SparkSession) -> SparkSession:
    """Give the executors this package and bound the Arrow batches; safe to call again and again."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_tileflow_shipped", False):
        return spark
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="tileflow-"), "tileflow_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    sc._tileflow_shipped = True
    return spark


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _made(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tileflow_tables"):
        sc._tileflow_tables = []
    return sc._tileflow_tables


@contextmanager
def only_results(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that are materialised inside, but for those put into the list that it gives."""
    before, keep = len(_made(spark)), []
    yield keep
    kept = {f.rpartition("/")[0].split("://")[-1].lstrip("/") for t in keep for f in t.inputFiles()}
    remove(spark, *[p for p in _made(spark)[before:] if p.split("://")[-1].lstrip("/") not in kept])
    del _made(spark)[before:]
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete shared paths that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and let go of finished shuffles."""
    remove(spark, *{f.rpartition("/")[0] for t in tables for f in t.inputFiles()})
    release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one function per task: make() runs once in the worker, its result once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            out = one(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """A dict that fills itself through a function and is emptied when it has grown too large."""

    def __init__(self, function: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, key):
        value = self.function(key)
        if len(self) >= self.entries:
            self.clear()
        self[key] = value
        return value
