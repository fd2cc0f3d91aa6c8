"""Additive shares as data: splitting, merging and sharing again. They give no security.

Masks depend on (id, seed) alone and stay below 2^61, so that sums and differences of values below 2^61 fit a bigint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 1 << 61
#: Doubles are shared in fixed point with so many binary places.
PLACES = 20


def mask(*keys: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(MASK))


def split(df: DataFrame, columns: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables (id, columns) whose sums are df's columns; nulls are null in both."""
    masks = {c: F.when(F.col(c).isNotNull(), mask(F.col("id"), F.lit(c), seed=seed)) for c in columns}
    return df.select("id", *[m.alias(c) for c, m in masks.items()]), df.select("id", *[(F.col(c) - m).alias(c) for c, m in masks.items()])


def reveal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns that two tables share."""
    columns = [c for c in a.columns if c != "id"]
    other = b.select("id", *[F.col(c).alias(f"other_{c}") for c in columns])
    return a.join(other, "id").select("id", *[(F.col(c) + F.col(f"other_{c}")).alias(c) for c in columns])


def share_again(a: DataFrame, b: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Other shares of the same values: a mask is added to one side and taken off the other."""
    columns = [c for c in a.columns if c != "id"]
    small = {c: F.pmod(F.xxhash64(F.col("id"), F.lit(c), F.lit(seed)), F.lit(1 << 60)) for c in columns}
    return a.select("id", *[(F.col(c) - m).alias(c) for c, m in small.items()]), b.select("id", *[(F.col(c) + m).alias(c) for c, m in small.items()])


def to_fixed(x: Column) -> Column:
    return F.round(x * float(1 << PLACES)).cast("long")


def from_fixed(x: Column) -> Column:
    return x / float(1 << PLACES)
