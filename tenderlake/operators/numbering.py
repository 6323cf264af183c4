"""Consecutive numbers over all rows without passing them through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.sources.tables import materialize


def number_rows(df: DataFrame, name: str, order: Sequence[str | Column], start: int = 1) -> DataFrame:
    """``df`` with a column ``name``: ``start``, ``start + 1``, ... in ``order``, which has to be total.

    The rows are sorted by ranges and written once, each with its range and its place there (the two parts of a monotonically increasing number). Then a row's number is its
    place behind the sizes of the ranges before. Only those sizes come to the driver, one for each range. A job runs while the result is built.
    """
    at = F.monotonically_increasing_id()
    ranges = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "number-rows")
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(ranges.groupBy(part.alias("_range")).count().collect())
    if not sizes:
        return ranges.drop("_at").withColumn(name, F.lit(None).cast("long"))
    keys = sorted(sizes)
    firsts = dict(zip(keys, accumulate([start, *(sizes[k] for k in keys[:-1])]), strict=True))
    first = F.element_at(F.create_map(*(F.lit(x) for pair in firsts.items() for x in pair)), part)
    return ranges.withColumn(name, (first + place).cast("long")).drop("_at")
