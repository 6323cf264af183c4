"""Keyword search by an index of three-character runs: which rows hold a run, in lists that are bucketed by the run.

A term of three characters or more can only stand in a row that holds all of the term's runs, so a search reads the list of each term's rarest run, which is one bucket of the index, intersects the lists,
and verifies what is left in the rows. Runs that very many rows hold say little and have no list; a term of such runs alone, or a shorter one, is only verified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.alerts import _grams
from tenderlake.operators.search import search, terms_of
from tenderlake.sources.tables import materialize


def build_index(df: DataFrame, key: str, fields: Sequence[str], table: str, buckets: int = 64, share: float = 0.05) -> None:
    """Write the tables ``<table>_runs`` (``gram, n``: in how many rows) and ``<table>_lists`` (``gram, key``), each bucketed by ``gram``; tables of these names are replaced.

    Runs that more than ``share`` of all rows hold have no list, so none of the lists is as long as the table, and no task gets a run of most rows. ``key`` names a row and isn't null. Runs are counted by an
    aggregate that is reduced before its shuffle.
    """
    spark = df.sparkSession
    text = F.concat_ws("\x01", *(F.lower(F.col(f).cast("string")) for f in fields))
    signs = df.select(F.col(key).alias("key"), F.split(text, "").alias("_signs"))
    held = materialize(signs.select("key", F.explode(_grams("_signs", [3])).alias("gram")), "search-runs")
    runs = materialize(held.groupBy("gram").agg(F.count("*").alias("n")), "search-counts")
    most = int(df.count() * share)
    often = runs.where(F.col("n") > most).select("gram")  # 1 / share of a row's length at most
    lists = held.join(F.broadcast(often) if often.count() <= 100_000 else often, "gram", "left_anti")
    for name, part in ((f"{table}_runs", runs.withColumn("listed", F.col("n") <= most)), (f"{table}_lists", lists)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # One sorted file a bucket, so that a run's rows stand together in it.
        part.repartition(buckets, "gram").sortWithinPartitions("gram").write.format("parquet").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(name)


def indexed_search(df: DataFrame, query: str | None, key: str, fields: Sequence[str], table: str, most: int = 1_000_000) -> DataFrame:
    """The rows that :func:`tenderlake.operators.search.search` finds, read by the index ``table`` of the same key and fields. Up to ``most`` candidates are broadcast to the rows; beyond that both are shuffled.

    Jobs run while the result is built: one that looks up how rare the query's runs are, and one that writes the candidates.
    """
    spark = df.sparkSession
    grams = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in map(str.lower, terms_of(query))}
    wanted = sorted({g for gs in grams.values() for g in gs})
    if not wanted:
        return search(df, query, fields)
    known = {r.gram: r for r in spark.table(f"{table}_runs").where(F.col("gram").isin(wanted)).collect()}
    if any(g not in known for g in wanted):
        return df.where("false")
    rarest = {min((known[g].n, g) for g in gs if known[g].listed)[1] for gs in grams.values() if any(known[g].listed for g in gs)}
    if not rarest:
        return search(df, query, fields)
    rows = spark.table(f"{table}_lists").where(F.col("gram").isin(sorted(rarest)))
    both = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select(F.col("key").alias("_found"))
    found = materialize(both, "search-candidates")
    side = F.broadcast(found) if found.count() <= most else found
    return search(df.join(side, df[key] == F.col("_found"), "left_semi"), query, fields)
