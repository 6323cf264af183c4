"""Nested records: single references as structs, children and many-to-many relations as ordered arrays.

Each relation is one join over whole tables, in place of a look-up for each row. Which side is broadcast is left to Spark, which knows
the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_one(df: DataFrame, other: DataFrame, on: tuple[str, str], name: str, fields: Sequence[str] | None = None, required: bool = False) -> DataFrame:
    """``df`` with the row of ``other`` that ``df[on[0]]`` names by ``other[on[1]]`` as a struct ``name``.

    Without a match the struct is null (not one of nulls); with ``required`` the row goes.
    """
    fields = fields or other.columns
    side = other.select(F.col(on[1]).alias("_key"), F.struct(*fields).alias(name))
    joined = df.join(side, df[on[0]] == side["_key"], "inner" if required else "left")
    return joined.drop("_key")


def _gathered(rows: DataFrame, key: Column, name: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    entry = F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("v"))
    gathered = rows.groupBy(key.alias("_parent")).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return gathered.select("_parent", F.transform("_list", lambda x: x["v"]).alias(name))


def nest_many(df: DataFrame, children: DataFrame, on: tuple[str, str], name: str, fields: Sequence[str], order: Sequence[str] = ("id",)) -> DataFrame:
    """``df`` with the rows of ``children`` whose ``on[1]`` is ``df[on[0]]`` as an array of structs, ordered; empty without any."""
    side = _gathered(children, F.col(on[1]), name, fields, order)
    out = df.join(side, df[on[0]] == side["_parent"], "left").drop("_parent")
    return out.withColumn(name, F.coalesce(name, F.array()))


def nest_through(df: DataFrame, bridge: DataFrame, target: DataFrame, on: tuple[str, str], to: tuple[str, str], name: str, fields: Sequence[str], order: Sequence[str] = ("id",)) -> DataFrame:
    """As :func:`nest_many`, through a bridge: ``df[on[0]] = bridge[on[1]]``, ``bridge[to[0]] = target[to[1]]``. Pairs that the bridge repeats stay repeated."""
    side = target.select(F.col(to[1]).alias("_to"), *(f for f in dict.fromkeys([*fields, *order])))
    linked = bridge.select(F.col(on[1]).alias("_from"), F.col(to[0]).alias("_via")).join(side, F.col("_via") == F.col("_to"))
    return nest_many(df, linked, (on[0], "_from"), name, fields, order)


def child_count(df: DataFrame, children: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """``df`` with the number of its children; 0 without any. Counted before the join, so a hot parent costs one row."""
    counts = children.groupBy(F.col(on[1]).alias("_parent")).agg(F.count("*").alias(name))
    return df.join(counts, df[on[0]] == counts["_parent"], "left").drop("_parent").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
