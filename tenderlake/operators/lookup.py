"""Looking up rows by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_named(df: DataFrame, named: DataFrame, column: str, name: str, as_: str) -> DataFrame:
    """``df`` with the row of ``named`` whose ``name`` is ``df[column]`` as a struct ``as_``; a null finds none, a name that nobody has fails the query.

    Names in ``named`` are distinct.
    """
    side = named.select(F.col(name).alias("_name"), F.struct(*named.columns).alias("_found"))
    unknown = F.raise_error(F.concat(F.lit(f"no {name} in the table is called "), F.col(column).cast("string")))
    found = F.when(F.col(column).isNull() | F.col("_found").isNotNull(), F.col("_found")).otherwise(unknown)
    joined = df.join(side, df[column] == F.col("_name"), "left")
    return joined.select(*df.columns, found.alias(as_))


def first_or_none(df: DataFrame, condition: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row in ``order`` (total) that meets the condition; none if no row does."""
    return df.where(condition).orderBy(*order).limit(1)
