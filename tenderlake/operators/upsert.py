"""Set-based writes: get-or-create, many-to-many add and replace, patch. Each returns the new state of a table as a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.numbering import number_rows


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows with one key (null is a key like others) the first in ``order``. An aggregate, so a hot key is reduced before the shuffle."""
    least = F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(*order)).alias("_row")
    return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key))).agg(least).select("_row.*")


def _same(a: DataFrame, b: DataFrame, key: Sequence[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in key]


def get_or_create(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str], id_col: str | None = "id") -> DataFrame:
    """``existing`` and, of the incoming rows whose key it lacks, the first of each key.

    Rows that exist are never changed. New rows get ids behind the largest one, in ``order``. Columns that the incoming rows lack are null.
    """
    fresh = first_wins(incoming, key, order)
    fresh = fresh.join(existing, _same(fresh, existing, key), "left_anti")
    if id_col:
        top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        fresh = number_rows(fresh, id_col, order, int(top) + 1)
    columns = [F.col(c).cast(t) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in existing.dtypes]
    return existing.unionByName(fresh.select(*columns))


def append(existing: DataFrame, incoming: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Insert all rows, repeats too, with ids behind the largest one, in ``order`` (total)."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    numbered = number_rows(incoming, id_col, order, int(top) + 1)
    return existing.unionByName(numbered.select(*(F.col(c).cast(t) for c, t in existing.dtypes)))


def add_links(bridge: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add the pairs that the bridge lacks, each once."""
    new = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    return get_or_create(bridge, new, [left, right], [left, right])


def replace_links(bridge: DataFrame, requests: DataFrame, left: str, right: str, ids: str) -> DataFrame:
    """For each request (``left``, array ``ids``): null leaves the links, an empty array clears them, another replaces them, repeats included."""
    touched = requests.where(F.col(ids).isNotNull())
    kept = bridge.join(touched.select(left).distinct(), left, "left_anti").select(*bridge.columns)
    pairs = touched.select(left, F.posexplode(ids).alias("_at", right)).select(left, right, "_at")
    top = bridge.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_rows(pairs, "id", [left, "_at"], int(top) + 1)
    return kept.unionByName(numbered.select(*(F.col(c).cast(t) for c, t in bridge.dtypes)))


def create_with_links(parents: DataFrame, bridges: dict[str, DataFrame], requests: DataFrame, order: Sequence[str], links: dict[str, tuple[str, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Insert requests and one bridge row for each listed id. ``links``: bridge name to (its parent column, its target column, the request's array)."""
    top = parents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_rows(requests, "id", order, int(top) + 1)
    out = {}
    for name, (left, right, ids) in links.items():
        asked = numbered.select(F.col("id").alias(left), F.coalesce(ids, F.array()).alias(ids))
        out[name] = replace_links(bridges[name], asked, left, right, ids)
    columns = [F.col(c).cast(t) if c in numbered.columns else F.lit(None).cast(t).alias(c) for c, t in parents.dtypes]
    return parents.unionByName(numbered.select(*columns)), out


def patch(table: DataFrame, changes: DataFrame, key: str = "id", given: str | None = "given") -> DataFrame:
    """Merge changes into rows of their key. ``given`` names an array of the columns that a change sets, null values among them; None: all its columns (a replacement).

    Changes whose key is unknown are left out. Two changes for one key are an error, since neither comes first.
    """
    fields = [c for c in changes.columns if c not in (key, given) and c in table.columns]
    side = changes.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields), *([F.col(given).alias("_given")] if given else []))
    several = F.raise_error(F.concat(F.lit("several changes for the key "), F.col("_key").cast("string")))
    once = side.groupBy("_key").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in side.columns if c != "_key"))
    once = once.withColumn("_key", F.when(F.col("_n") == 1, F.col("_key")).otherwise(several))
    joined = table.join(once, table[key] == once["_key"], "left")
    present = lambda f: F.col("_key").isNotNull() & (F.array_contains("_given", f) if given else F.lit(True))
    return joined.select(*(F.when(present(c), F.col(f"_{c}").cast(t)).otherwise(table[c]).alias(c) if c in fields else table[c] for c, t in table.dtypes))
