"""Small value functions: defaults, formatted numbers, seeded choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def draw(seed: int, *parts: Column | str) -> Column:
    """A number from 0 up to 2**31 that depends on the seed and the parts alone: the same on any cluster and after any retry."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 31))


def draw_between(low: int, high: int, seed: int, *parts: Column | str) -> Column:
    """From ``low`` to ``high``, both included."""
    return F.lit(low) + draw(seed, *parts) % (high - low + 1)


def draw_some(values: Column, count: Column, seed: int, *parts: Column | str) -> Column:
    """``count`` elements of an array without replacement: those whose hashes are least."""
    ranked = F.array_sort(F.transform(values, lambda v: F.struct(F.xxhash64(F.lit(seed), *parts, v).alias("h"), v.alias("v"))))
    return F.transform(F.slice(ranked, F.lit(1), count.cast("int")), lambda x: x["v"])
