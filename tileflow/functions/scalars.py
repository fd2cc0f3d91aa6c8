"""Integer, vector, string and random functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ilog2(x: Column) -> Column:
    """Position of the highest set bit; null below 1."""
    return F.when(x >= 1, F.length(F.bin(x)) - 1).cast("int")


def is_pow2(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def next_pow2(x: Column) -> Column:
    """The smallest power of two that is x or more; 1 for 0."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)).cast("int")))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return inner(a, a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def tokens(s: Column, delimiters: str) -> Column:
    """The parts of s between any of the delimiters, empty ones left out."""
    kind = "[" + "".join(f"\\x{ord(c):02x}" for c in delimiters) + "]"
    return F.filter(F.split(s, kind), lambda x: x != "")


def unit_draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that a lost task draws the same again."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def int_draw(low: int, high: int, *keys: Column, seed: int = 0) -> Column:
    """An integer from low to high, both included, that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(high - low + 1)) + low).cast("long")


def softmax(a: Column) -> Column:
    """Of an array of numbers; the largest is taken off first, so nothing overflows."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def running_sum(a: Column) -> Column:
    """Sums of an array's beginnings, in one pass."""
    none = F.lit(0.0)
    return F.slice(F.aggregate(a, F.array(none), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))), F.lit(2), F.greatest(F.size(a), F.lit(1)))
