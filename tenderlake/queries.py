"""The registered queries on the generated tables, each with the SQL that gives the same rows.

The tables stand in for the catalogue's: orders for publications and contracts, customers for companies, line items for lots and bridges, parts
for domains, conversations for paged documents, events for alerts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.defaults import has_text, or_empty
from tenderlake.functions.urls import basename, resolve_simple, url_path
from tenderlake.operators import alerts, bloom, documents, integrity, lookup, names, nesting, ordering, search_index, sections, upsert
from tenderlake.operators.search import search
from tenderlake.plans import writes
from tenderlake.plans.ingest import save_payloads
from tenderlake.plans.resources import list_resource, response
from tenderlake.schemas import CASCADE, SET_NULL, TABLES, Column, Reference, Table
from tenderlake.sources.files import parse_payloads
from tenderlake.sources.tables import load_table, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(column: str):
    return F.col(column).cast("decimal(15,2)")


def as_text(column: str, name: str | None = None):
    return F.col(column).cast("string").alias(name or column)


def json_of(column: str):
    return F.to_json(F.col(column), {"ignoreNullFields": "false"}).alias(column)


# Search and order.


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%'")
def search_single_table(spark: SparkSession, sf: str) -> DataFrame:
    return search(load_table(spark, sf, "part"), "WIDGET", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""
SELECT p_partkey, p_name, p_type FROM part
WHERE (lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%') AND (lower(p_name) LIKE '%economy%' OR lower(p_type) LIKE '%economy%')
""")
def search_multi_term(spark: SparkSession, sf: str) -> DataFrame:
    return search(load_table(spark, sf, "part"), "red, Economy", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'of the') AND contains(lower(text), 'and')")
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return search(load_table(spark, sf, "documents"), '"of the" and', ["text"]).select("doc_id", "lang")


@query("""
SELECT o_orderkey, o_orderpriority, c_name FROM orders LEFT JOIN customer ON c_custkey = nullif(o_custkey, 7)
WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(c_name) LIKE '%urgent%'
""")
def search_across_join(spark: SparkSession, sf: str) -> DataFrame:
    o = load_table(spark, sf, "orders").withColumn("winner", F.nullif("o_custkey", F.lit(7)))
    c = load_table(spark, sf, "customer")
    return search(o.join(c, o["winner"] == c["c_custkey"], "left"), "urgent", ["o_orderpriority", "c_name"]).select("o_orderkey", "o_orderpriority", "c_name")


@query("""
SELECT 'kernel' AS search, conv_id, turn FROM conversations WHERE lower(text) LIKE '%entre%' AND lower(text) LIKE '%tion de%'
UNION ALL SELECT 'rare', conv_id, turn FROM conversations WHERE lower(text) LIKE '%schst%'
""")
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Two searches of all turns by an index that is built first and dropped at the end."""
    turns = load_table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    table = f"turns_{uuid.uuid4().hex}"
    search_index.build_index(turns, "key", ["text"], table, buckets=16)
    searches = {"kernel": 'entre "tion de"', "rare": "schst"}
    found = [search_index.indexed_search(turns, text, "key", ["text"], table).select(F.lit(name).alias("search"), "conv_id", "turn") for name, text in searches.items()]
    out = materialize(reduce(DataFrame.unionByName, found), "search-indexed")
    for part in ("runs", "lists"):
        spark.sql(f"DROP TABLE {table}_{part}")
    return out


def ranked(df: DataFrame, *columns) -> DataFrame:
    """The position of each row in a total order, so that the order itself is compared."""
    from tenderlake.operators.numbering import number_rows

    return number_rows(df, "position", columns)


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_publication, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position FROM orders")
def order_default_desc(spark: SparkSession, sf: str) -> DataFrame:
    o = load_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date_publication"))
    columns = ordering.order_columns("nothing,-unknown", ["date_publication"], "-date_publication", ("o_orderkey",))
    return ranked(o, *columns).select("o_orderkey", as_text("date_publication"), "position")


@query("""
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS kind, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS budget,
  row_number() OVER (ORDER BY nullif(o_orderpriority, '5-LOW') ASC NULLS FIRST, CAST(o_totalprice AS DECIMAL(15,2)) DESC NULLS LAST, o_orderkey) AS position FROM orders
""")
def order_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    o = load_table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("kind"), money("o_totalprice").alias("budget"))
    columns = ordering.order_columns("kind,secret,-budget", ["kind", "budget"], None, ("o_orderkey",))
    return ranked(o, *columns).select("o_orderkey", "kind", as_text("budget"), "position")


@query("""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_publication, c_name AS source FROM orders JOIN customer ON o_custkey = c_custkey
WHERE (lower(c_name) LIKE '%00001%' OR lower(o_orderpriority) LIKE '%00001%') AND (lower(c_name) LIKE '%high%' OR lower(o_orderpriority) LIKE '%high%')
""")
def publication_list(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a keyword search over a join, newest first."""
    o, c = load_table(spark, sf, "orders"), load_table(spark, sf, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderdate", "c_name", "o_orderpriority")
    found = search(rows, "00001 HIGH", ["c_name", "o_orderpriority"])
    listed = ordering.order(found, "-o_orderdate", ["o_orderdate"], tie=("o_orderkey",))
    return listed.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("date_publication"), F.col("c_name").alias("source"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def detail_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT o_orderkey FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1998-05-01' AND CAST(o_orderdate AS DATE) < DATE '1998-06-01'
""")
def date_facet(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.date_facet(load_table(spark, sf, "orders"), "o_orderdate", "month", F.lit("1998-05-17")).select("o_orderkey")


FACETS = {
    "today": "d = DATE '1998-05-17'",
    "past_7_days": "d >= DATE '1998-05-10' AND d <= DATE '1998-05-17'",
    "year": "d >= DATE '1998-01-01' AND d < DATE '1999-01-01'",
    "null": "d IS NULL",
    "not_null": "d IS NOT NULL",
    "any": "TRUE",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS facet, o_orderkey FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS DATE) AS d FROM orders) WHERE {test}" for name, test in FACETS.items()))
def date_facets_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every other choice of the date facet, over orders of which some have no date."""
    o = load_table(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    parts = [alerts.date_facet(o, "o_orderdate", name, F.lit("1998-05-17")).select(F.lit(name).alias("facet"), "o_orderkey") for name in FACETS]
    return reduce(DataFrame.unionByName, parts)


# Nested records.


@query("""
SELECT o_orderkey, coalesce(to_json(list({'numero_lot': l_linenumber, 'part': l_partkey, 'montant': CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)}
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_orderkey IS NOT NULL)), '[]')::VARCHAR AS lots
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nest_many_children(spark: SparkSession, sf: str) -> DataFrame:
    lots = load_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("numero_lot"), F.col("l_partkey").alias("part"), money("l_extendedprice").cast("string").alias("montant"), "l_suppkey", "l_extendedprice")
    df = nesting.nest_many(load_table(spark, sf, "orders").select("o_orderkey"), lots, ("o_orderkey", "l_orderkey"), "lots", ["numero_lot", "part", "montant"], ["numero_lot", "part", "l_suppkey", "l_extendedprice"])
    return df.select("o_orderkey", json_of("lots"))


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE to_json({'id': c_custkey, 'nom': c_name})::VARCHAR END AS entreprise
FROM orders LEFT JOIN customer ON c_custkey = nullif(o_custkey, 7)
""")
def nest_one_nullable(spark: SparkSession, sf: str) -> DataFrame:
    o = load_table(spark, sf, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("winner"))
    c = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"))
    return nesting.nest_one(o, c, ("winner", "id"), "entreprise").select("o_orderkey", json_of("entreprise"))


@query("""
SELECT o_orderkey, coalesce(to_json(list({'id': p_partkey, 'libelle': p_name} ORDER BY p_partkey) FILTER (p_partkey IS NOT NULL)), '[]')::VARCHAR AS domaines
FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nest_m2m_keep_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    parts = load_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("libelle"))
    df = nesting.nest_through(load_table(spark, sf, "orders").select("o_orderkey"), load_table(spark, sf, "lineitem"), parts, ("o_orderkey", "l_orderkey"), ("l_partkey", "id"), "domaines", ["id", "libelle"])
    return df.select("o_orderkey", json_of("domaines"))


@query("""
WITH d AS (SELECT l_suppkey, list({'id': p_partkey, 'libelle': p_name} ORDER BY p_partkey) AS domaines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
     s AS (SELECT l_suppkey, list({'id': o_orderkey, 'nom': o_orderstatus} ORDER BY o_orderkey) AS secteurs FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT s_suppkey, coalesce(to_json(domaines)::VARCHAR, '[]') AS domaines, coalesce(to_json(secteurs)::VARCHAR, '[]') AS secteurs
FROM supplier LEFT JOIN d ON d.l_suppkey = s_suppkey LEFT JOIN s ON s.l_suppkey = s_suppkey
""")
def nest_two_m2m(spark: SparkSession, sf: str) -> DataFrame:
    lines = load_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    parts = load_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("libelle"))
    orders = load_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("nom"))
    df = nesting.nest_through(load_table(spark, sf, "supplier").select("s_suppkey"), lines, parts, ("s_suppkey", "l_suppkey"), ("l_partkey", "id"), "domaines", ["id", "libelle"])
    df = nesting.nest_through(df, lines, orders, ("s_suppkey", "l_suppkey"), ("l_orderkey", "id"), "secteurs", ["id", "nom"])
    return df.select("s_suppkey", json_of("domaines"), json_of("secteurs"))


@query("""
SELECT l_orderkey AS marche_ptr_id, o_orderstatus, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
""")
def inherit_join(spark: SparkSession, sf: str) -> DataFrame:
    child = load_table(spark, sf, "lineitem").where("l_linenumber = 1")
    parent = load_table(spark, sf, "orders")
    return child.join(parent, child["l_orderkey"] == parent["o_orderkey"]).select(F.col("l_orderkey").alias("marche_ptr_id"), "o_orderstatus", "l_partkey")


@query("""
SELECT event_id, to_json({'id': c_custkey, 'nom': c_name, 'nation': {'id': n_nationkey, 'nom': n_name}})::VARCHAR AS entreprise, event_type AS type_alerte,
  row_number() OVER (ORDER BY ts DESC, event_id) AS position
FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey
""")
def alert_feed_nested(spark: SparkSession, sf: str) -> DataFrame:
    nations = load_table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"))
    firms = nesting.nest_one(load_table(spark, sf, "customer"), nations, ("c_nationkey", "id"), "nation", required=True).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"), "nation")
    feed = nesting.nest_one(load_table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("type_alerte")), firms, ("user_id", "id"), "entreprise", required=True)
    return ranked(feed, *ordering.order_columns("-ts", ["ts"], None, ("event_id",))).select("event_id", json_of("entreprise"), "type_alerte", "position")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def child_count(spark: SparkSession, sf: str) -> DataFrame:
    return nesting.child_count(load_table(spark, sf, "customer").select("c_custkey"), load_table(spark, sf, "orders"), ("c_custkey", "o_custkey"), "n_orders")


# Writes.

FIRST = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS montant FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(FIRST)}) = 1
""")
def upsert_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = upsert.first_wins(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], FIRST)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").cast("string").alias("montant"))


@query("""
WITH e AS (SELECT c_custkey + 1 AS id, c_name AS nom, c_mktsegment AS description FROM customer WHERE c_custkey % 3 = 0),
     n AS (SELECT c_name AS nom, 'new' AS description, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_name NOT IN (SELECT nom FROM e))
SELECT id, nom, description FROM e UNION ALL SELECT (SELECT max(id) FROM e) + r, nom, description FROM n
""")
def upsert_into_existing(spark: SparkSession, sf: str) -> DataFrame:
    c = load_table(spark, sf, "customer")
    existing = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("nom"), F.col("c_mktsegment").alias("description"))
    # Every company comes twice; the second time with another description, which must lose.
    incoming = c.select("c_custkey", F.col("c_name").alias("nom"), F.explode(F.array(F.lit("new"), F.lit("newer"))).alias("description"))
    return upsert.get_or_create(existing, incoming, ["nom"], ["c_custkey", "description"])


@query("""
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2)
SELECT DISTINCT l_orderkey, l_partkey FROM lineitem
""")
def m2m_add_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = load_table(spark, sf, "lineitem")
    pairs = lines.select("l_orderkey", "l_partkey")
    old = lines.where("l_linenumber <= 2").select("l_orderkey", "l_partkey").distinct()
    bridge = old.select(F.xxhash64("l_orderkey", "l_partkey").alias("id"), "l_orderkey", "l_partkey").withColumn("id", F.pmod("id", F.lit(1 << 40)))
    return upsert.add_links(bridge, pairs, "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey")


@query("""
SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, unnest([o_custkey, o_custkey]) FROM orders WHERE o_orderkey % 3 = 2
""")
def m2m_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Of the orders, a third isn't named (null), a third is cleared, a third gets its customer twice."""
    lines = load_table(spark, sf, "lineitem").select(F.lit(1).cast("long").alias("id"), "l_orderkey", "l_partkey")
    turn = F.col("o_orderkey") % 3
    asked = F.when(turn == 1, F.array().cast("array<long>")).when(turn == 2, F.array("o_custkey", "o_custkey"))
    requests = load_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), asked.alias("ids"))
    kept = lines.join(requests.select("l_orderkey"), "l_orderkey", "left_semi").select("id", "l_orderkey", "l_partkey")
    return upsert.replace_links(kept, requests, "l_orderkey", "l_partkey", "ids").select("l_orderkey", "l_partkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 1 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority FROM orders
""")
def patch_partial(spark: SparkSession, sf: str) -> DataFrame:
    """One quarter sets a status of null, another a priority; what isn't given stays."""
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    turn = F.col("o_orderkey") % 4
    changes = o.where(turn < 2).select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.lit("patched").alias("o_orderpriority"), F.when(turn == 0, F.array(F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_orderpriority"))).alias("given"))
    return upsert.patch(o, changes, "o_orderkey")


def _geography(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, Table]]:
    tables = {n: load_table(spark, sf, n) for n in ("region", "nation", "customer", "orders", "supplier")}
    metadata = {
        t.name: t
        for t in (
            Table("region", (), "r_regionkey"),
            Table("nation", (), "n_nationkey", (Reference("n_regionkey", "region", CASCADE),)),
            Table("customer", (), "c_custkey", (Reference("c_nationkey", "nation", CASCADE),)),
            Table("orders", (), "o_orderkey", (Reference("o_custkey", "customer", CASCADE),)),
            Table("supplier", (), "s_suppkey", (Reference("s_nationkey", "nation", SET_NULL),)),
        )
    }
    return tables, metadata


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)
""")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    tables, metadata = _geography(spark, sf)
    after = integrity.delete(tables, "region", tables["region"].where("r_name = 'AMERICA'").select("r_regionkey"), metadata)
    return after["orders"].select("o_orderkey", "o_custkey")


@query("""
SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
""")
def delete_set_null(spark: SparkSession, sf: str) -> DataFrame:
    tables, metadata = _geography(spark, sf)
    after = integrity.delete(tables, "region", tables["region"].where("r_name = 'AMERICA'").select("r_regionkey"), metadata)
    return after["supplier"].select("s_suppkey", "s_nationkey")


@query("""
WITH c AS (SELECT c_custkey AS id, c_name AS nom, c_nationkey FROM customer),
     n AS (SELECT row_number() OVER (ORDER BY s_suppkey) + (SELECT max(id) FROM c) AS id, s_name AS nom, s_suppkey FROM supplier)
SELECT id, nom, CAST(NULL AS BIGINT) AS lien FROM c UNION ALL SELECT id, nom, NULL FROM n
UNION ALL SELECT id, 'lien', s_suppkey FROM n UNION ALL SELECT id, 'lien', s_suppkey + 1 FROM n WHERE s_suppkey % 2 = 0
""")
def create_with_links(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers become companies with ids behind the largest one; each names one or two targets, and gets one bridge row for each."""
    parents = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"))
    s = load_table(spark, sf, "supplier")
    asked = F.when(F.col("s_suppkey") % 2 == 0, F.array("s_suppkey", F.col("s_suppkey") + 1)).otherwise(F.array("s_suppkey"))
    requests = s.select("s_suppkey", F.col("s_name").alias("nom"), asked.alias("domaine_ids"))
    bridge = spark.createDataFrame([], "id bigint, entreprise_id bigint, domaine_id bigint")
    rows, bridges = upsert.create_with_links(parents, {"b": bridge}, requests, ["s_suppkey"], {"b": ("entreprise_id", "domaine_id", "domaine_ids")})
    links = bridges["b"].select(F.col("entreprise_id").alias("id"), F.lit("lien").alias("nom"), F.col("domaine_id").alias("lien"))
    return rows.select("id", "nom", F.lit(None).cast("bigint").alias("lien")).unionByName(links)


@query("""
SELECT event_id AS id, event_type AS type_alerte FROM events
UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity), 'lot' FROM lineitem
""")
def append_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Every row is appended, repeats too, with ids behind the largest one."""
    stored = load_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type_alerte"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return upsert.append(stored, load_table(spark, sf, "lineitem").select(*order, F.lit("lot").alias("type_alerte")), order)


# Requests and payloads.

FIRMS = {
    "nation": Table("nation", (), "n_nationkey"),
    "firm": Table("firm", (Column("id", "long"), Column("nom", "str", unique=True, max_length=40), Column("nation_id", "int")), references=(Reference("nation_id", "nation", CASCADE),)),
}


def _firms(spark: SparkSession, sf: str, stored: str) -> dict[str, DataFrame]:
    firm = load_table(spark, sf, "customer").where(stored).select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("nom"), F.col("c_nationkey").alias("nation_id"))
    return {"nation": load_table(spark, sf, "nation"), "firm": firm}


def _created(spark: SparkSession, sf: str) -> writes.Written:
    """A third of the companies is stored; all are asked for, some without a nation or with one that isn't there."""
    c = load_table(spark, sf, "customer")
    key = F.col("c_custkey")
    nation = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, 99).otherwise(F.col("c_nationkey"))
    return writes.create(_firms(spark, sf, "c_custkey % 3 = 0"), "firm", c.select(key.alias("arrival"), F.col("c_name").alias("nom"), nation.alias("nation_id")), FIRMS, {})


@query("""
WITH e AS (SELECT c_custkey + 1 AS id, c_name AS nom, c_nationkey AS nation_id FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM e UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY c_custkey), c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
""")
def create_by_request(spark: SparkSession, sf: str) -> DataFrame:
    return _created(spark, sf).tables["firm"]


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'required' AS rule, 'nation_id' AS field, CAST(NULL AS VARCHAR) AS value FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'reference', 'nation_id', '99' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unique', 'nom', c_name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0
""")
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _created(spark, sf).refused


@query("""
SELECT c_custkey + 1 AS id, CASE WHEN c_custkey % 4 = 1 THEN 'new ' || c_name WHEN c_custkey = 2 THEN 'one name' ELSE c_name END AS nom,
  CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE c_nationkey END AS nation_id FROM customer
""")
def change_by_request(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter keeps its name, one gets a free name, one asks for the same name (the first gets it), one gets a nation and no name."""
    key = F.col("c_custkey")
    nom = F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.concat(F.lit("new "), "c_name")).when(key % 4 == 2, "one name")
    given = F.when(key % 4 == 3, F.array(F.lit("nation_id"))).otherwise(F.array(F.lit("nom")))
    requests = load_table(spark, sf, "customer").select(key.alias("arrival"), (key + 1).alias("id"), nom.alias("nom"), F.lit(1).alias("nation_id"), given.alias("given"))
    return writes.change(_firms(spark, sf, "true"), "firm", requests, metadata=FIRMS, links={}).tables["firm"]


def _taken_in(spark: SparkSession, sf: str) -> Mapping[str, DataFrame]:
    """All orders as extraction payloads: a company, its domain, a publication for each day, a contract for each priority, an alert for finished ones."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    company = F.struct(F.concat(F.lit("firm "), F.col("o_custkey").cast("string")).alias("nom"), key.cast("string").alias("siret"), F.array("o_orderstatus").alias("domaines"))
    publication = F.struct(day.alias("numero"), day.alias("date_publication"), key.cast("string").alias("titre"))
    contract = F.struct(F.col("o_orderpriority").alias("objet"), key.cast("string").alias("region"))
    alert = F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("fin").alias("type_alerte"), key.cast("string").alias("contenu_alerte")))
    award = F.struct(key.cast("int").alias("nombre_offres_recues"))
    parts = F.struct(key.alias("arrival"), company.alias("entreprise"), publication.alias("publication"), contract.alias("marche"), alert.alias("alerte"), award.alias("resultat"), F.col("o_orderpriority").alias("type_procedure"))
    payloads = parse_payloads(load_table(spark, sf, "orders").select(F.to_json(parts).alias("body")))
    return save_payloads({n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()}, payloads, F.lit("2024-05-01 00:00:00"))


@query("""
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS numero FROM orders),
     m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY numero, o_orderpriority ORDER BY o_orderkey) = 1)
SELECT row_number() OVER (ORDER BY o_orderkey) AS id, numero, o_orderpriority AS objet, CAST(o_orderkey AS VARCHAR) AS region, o_orderpriority AS procedure,
  'firm ' || o_custkey AS attributaire, CAST(o_orderkey AS INTEGER) AS offres, CAST(min(o_orderkey) OVER (PARTITION BY numero) AS VARCHAR) AS titre
FROM m
""")
def payload_awards(spark: SparkSession, sf: str) -> DataFrame:
    """Awards of all payloads as the service lists them, four levels deep, flattened again."""
    listed = list_resource(_taken_in(spark, sf), "resultats")
    return listed.select(
        F.col("marche.id").alias("id"), F.col("marche.publication.numero").alias("numero"), F.col("marche.objet").alias("objet"), F.col("marche.region").alias("region"), F.col("marche.type_procedure.libelle").alias("procedure"),
        F.col("entreprise_attributaire.nom").alias("attributaire"), F.col("nombre_offres_recues").alias("offres"), F.col("marche.publication.titre").alias("titre"),
    )


@query("""
SELECT row_number() OVER (ORDER BY o_orderkey) AS id, 'firm ' || o_custkey AS entreprise, strftime(o_orderdate, '%Y-%m-%d') AS numero, CAST(o_orderkey AS VARCHAR) AS contenu,
  (SELECT string_agg(DISTINCT s.o_orderstatus, ',' ORDER BY s.o_orderstatus) FROM orders s WHERE s.o_custkey = o.o_custkey) AS domaines
FROM orders o WHERE o_orderstatus = 'F'
""")
def payload_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of all payloads, with the company's domains."""
    shown = list_resource(_taken_in(spark, sf), "alertes")
    domains = F.array_join(F.array_sort(F.transform("entreprise.domaines", lambda d: d["libelle"])), ",")
    return shown.select("id", F.col("entreprise.nom").alias("entreprise"), F.col("publication.numero").alias("numero"), F.col("contenu_alerte").alias("contenu"), domains.alias("domaines"))


@query("SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def find_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Companies name their nation; a name that no nation has would be an error."""
    nations = load_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    names = load_table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("named"))
    return lookup.find_named(names, nations, "named", "n_name", "nation").select("c_custkey", "nation.n_nationkey", "nation.n_regionkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_or_none(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_or_none(load_table(spark, sf, "orders"), F.col("o_orderstatus") == "P", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


# Rules.


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'unique' AS rule, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
""")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.unique_violations(load_table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS row_key, 'reference' AS rule, 'l_partkey' AS field, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)
""")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.reference_violations(load_table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", load_table(spark, sf, "part").where("p_size <= 40"), "p_partkey")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'max_length' AS rule, 'p_name' AS field, p_name AS value FROM part WHERE length(p_name) > 10
""")
def length_violations(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.length_violations(load_table(spark, sf, "part"), "p_name", "p_partkey", 10)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'required' AS rule, 'o_orderstatus' AS field, CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'P'
""")
def missing_violations(spark: SparkSession, sf: str) -> DataFrame:
    o = load_table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return integrity.missing_violations(o, "o_orderstatus", "o_orderkey")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'equals o_custkey' AS rule, 'other' AS field, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey + o_orderkey % 5 - 1 END AS VARCHAR) AS value
FROM orders WHERE o_orderkey % 5 <> 1
""")
def equality_violations(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("o_orderkey") % 5
    o = load_table(spark, sf, "orders").withColumn("other", F.when(turn != 0, F.col("o_custkey") + turn - 1))
    return integrity.equality_violations(o, "other", "o_custkey", "o_orderkey")


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN replace(url, '://', ':/') ELSE url END AS url FROM pages)
SELECT CAST(page_id AS VARCHAR) AS row_key, 'url' AS rule, 'url' AS field, url AS value FROM p
WHERE url <> '' AND NOT regexp_matches(url, '^(?:https?|ftps?)://[^\s/?#:]+(?::[0-9]{2,5})?(?:[/?#]\S*)?$')
""")
def form_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page has an address with a slash too few."""
    pages = load_table(spark, sf, "pages")
    return integrity.form_violations(pages.withColumn("url", F.when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(F.col("url"))), "url", "page_id", "url")


# Crawled pages and paged documents.

LINKS_SQL = """WITH l AS (SELECT page_id, url, unnest(a) AS href, unnest(range(len(a))) AS position FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS a FROM pages))"""


@query(f"{LINKS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, href FROM l")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return documents.extract_links(load_table(spark, sf, "pages")).select("page_id", "position", "href")


@query(f"{LINKS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, href FROM l WHERE contains(href, 'The') OR contains(href, 'an')")
def filter_links_contains(spark: SparkSession, sf: str) -> DataFrame:
    return documents.links_containing(documents.extract_links(load_table(spark, sf, "pages")), ("The", "an")).select("page_id", "position", "href")


@query(f"{LINKS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, 'https://www.example.org' || href AS file_url FROM l WHERE href LIKE '%ble'")
def filter_links_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return documents.listed_urls(load_table(spark, sf, "pages"), "https://www.example.org", suffix="ble").select("page_id", "position", "file_url")


@query(f"{LINKS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS file_url FROM l")
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    links = documents.extract_links(load_table(spark, sf, "pages"))
    return links.select("page_id", "position", resolve_simple(F.col("url"), F.col("href")).alias("file_url"))


@query(f"{LINKS_SQL} SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS file_url FROM l WHERE contains(href, 'th')")
def crawl_document_urls(spark: SparkSession, sf: str) -> DataFrame:
    return documents.document_urls(load_table(spark, sf, "pages"), parts=("th",)).select("page_id", "position", "file_url")


BASENAME_SQL = r"regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)"


@query(f"""
WITH p AS (SELECT page_id, url, {BASENAME_SQL} AS file_name FROM pages),
     m AS (SELECT DISTINCT file_name FROM p WHERE page_id % 5 = 0)
SELECT file_name, page_id, url FROM p WHERE file_name NOT IN (SELECT file_name FROM m) AND page_id % 7 <> 0
QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id) = 1
""")
def manifest_new_files(spark: SparkSession, sf: str) -> DataFrame:
    pages = load_table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"))
    manifest = pages.where("page_id % 5 = 0").select(basename(url_path("url")).alias("file_name")).distinct()
    return documents.files_to_fetch(pages, manifest, ["page_id"], "url").select("file_name", "page_id", "url")


@query("""
SELECT conv_id, turn, text FROM conversations
QUALIFY count(*) OVER (PARTITION BY conv_id) > 2 AND turn > min(turn) OVER (PARTITION BY conv_id) AND turn < max(turn) OVER (PARTITION BY conv_id)
""")
def trim_first_last_page(spark: SparkSession, sf: str) -> DataFrame:
    return documents.trim_pages(load_table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, 'page_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '.pdf' AS file_name FROM conversations")
def split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return documents.split_pages(load_table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "file_name")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def concat_pages(spark: SparkSession, sf: str) -> DataFrame:
    return documents.full_text(load_table(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, max(text) FILTER (turn = 3) AS text FROM conversations GROUP BY 1")
def page_at(spark: SparkSession, sf: str) -> DataFrame:
    return documents.page_text(load_table(spark, sf, "conversations"), 3, "conv_id", "turn")


@query("SELECT conv_id, count(*) AS n_pages, max(length(text)) AS longest FROM conversations GROUP BY 1")
def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.max(F.length("text")).cast("long").alias("longest"))


# Whole resources.


def _catalogue(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The catalogue's tables from the generated ones: orders as publications and contracts, line items as lots, nations as kinds of procedure and domains, regions as sectors, customers as companies and users."""
    o, li, n, r, c = (load_table(spark, sf, x) for x in ("orders", "lineitem", "nation", "region", "customer"))
    key, firm = F.col("o_orderkey"), F.col("c_custkey")
    given = {
        "publication": o.select(key.alias("id"), F.col("o_orderpriority").alias("titre"), key.cast("string").alias("numero"), F.to_date("o_orderdate").alias("date_publication"), F.col("o_orderstatus").alias("source")),
        "type_procedure": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("libelle"), F.col("n_regionkey").alias("description")),
        "marche": o.select(key.alias("id"), key.alias("publication_id"), (F.col("o_custkey") % 30).alias("type_procedure_id"), F.col("o_orderstatus").alias("region"), F.concat(F.lit("objet "), key).alias("objet"), F.col("o_totalprice").alias("budget_min")),
        "lot": li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("marche_id"), F.col("l_linenumber").alias("numero_lot"), F.col("l_extendedprice").alias("montant")),
        "domaine": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("libelle"), F.col("n_regionkey").alias("description")),
        "secteur_activite": r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("nom")),
        "publication_domaine": o.select(key.alias("id"), key.alias("publication_id"), (F.col("o_custkey") % 25).alias("domaine_id")),
        "entreprise": c.select(firm.alias("id"), F.col("c_name").alias("nom"), firm.alias("numero_identification"), F.concat(F.lit("s"), firm).alias("siret"), F.lit("").alias("repprenom")),
        "entreprise_domaine": c.select(firm.alias("id"), firm.alias("entreprise_id"), F.col("c_nationkey").alias("domaine_id")),
        "entreprise_secteur": c.select(firm.alias("id"), firm.alias("entreprise_id"), (firm % 5).alias("secteur_id")),
        "utilisateur": c.select(firm.alias("id"), F.concat("c_mktsegment", F.lit("@x.org")).alias("email"), F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"), F.when(firm % 3 == 0, firm + 1).alias("entreprise_id"), F.lit(True).alias("notifications_actives")),
    }
    typed = lambda df, t: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema))
    return {name: typed(given[name], t) if name in given else spark.createDataFrame([], t.schema) for name, t in TABLES.items()}


@query("""
SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS numero, n2.n_name AS domaine, n1.n_name AS procedure, o_orderstatus AS region, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS budget,
  CAST(l_linenumber AS VARCHAR) AS numero_lot, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS montant
FROM orders JOIN nation n2 ON n2.n_nationkey = o_custkey % 25 LEFT JOIN nation n1 ON n1.n_nationkey = o_custkey % 30 LEFT JOIN lineitem ON l_orderkey = o_orderkey
""")
def resource_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """All contracts as the service lists them, with publication, its domains, procedure and lots, flattened again."""
    listed = list_resource(_catalogue(spark, sf), "marches")
    flat = listed.select("id", F.col("publication.numero").alias("numero"), F.element_at("publication.domaines", 1)["libelle"].alias("domaine"), F.col("type_procedure.libelle").alias("procedure"), "region", as_text("budget_min", "budget"), F.explode_outer("lots").alias("lot"))
    return flat.select("id", "numero", "domaine", "procedure", "region", "budget", F.col("lot.numero_lot").cast("string").alias("numero_lot"), F.col("lot.montant").cast("string").alias("montant"))


@query("""
SELECT 'types-procedure' AS resource, CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CAST(NULL AS VARCHAR) AS description FROM nation
UNION ALL SELECT 'domaines', n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 'secteurs', r_regionkey, r_name, NULL FROM region
UNION ALL SELECT 'publications-domaines', o_orderkey, CAST(o_orderkey AS VARCHAR), CAST(o_custkey % 25 AS VARCHAR) FROM orders
UNION ALL SELECT 'entreprises-domaines', c_custkey, n_name, CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'entreprises-secteurs', c_custkey, r_name, NULL FROM customer JOIN region ON r_regionkey = c_custkey % 5
""")
def resource_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The resources of labels and of bridges, each as the service lists it."""
    t = _catalogue(spark, sf)
    shown = {
        "types-procedure": ("libelle", F.lit(None).cast("string")),
        "domaines": ("libelle", F.col("description")),
        "secteurs": ("nom", F.col("description")),
        "publications-domaines": ("publication_id", F.col("domaine_id").cast("string")),
        "entreprises-domaines": ("domaine.libelle", F.col("domaine.description")),
        "entreprises-secteurs": ("secteur.nom", F.col("secteur.description")),
    }
    parts = [list_resource(t, name).select(F.lit(name).alias("resource"), "id", F.col(label).cast("string").alias("label"), more.alias("description")) for name, (label, more) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
SELECT u.c_custkey AS id, u.c_mktsegment || '@x.org' AS email, u.c_mktsegment AS first_name, u.c_name AS last_name, e.c_name AS entreprise, n_name AS domaine
FROM customer u LEFT JOIN customer e ON u.c_custkey % 3 = 0 AND e.c_custkey = u.c_custkey + 1 LEFT JOIN nation ON n_nationkey = e.c_nationkey
""")
def resource_users(spark: SparkSession, sf: str) -> DataFrame:
    """All users with their company; one without has none."""
    listed = list_resource(_catalogue(spark, sf), "utilisateurs")
    return listed.select("id", "email", "first_name", "last_name", F.col("entreprise.nom").alias("entreprise"), F.element_at("entreprise.domaines", 1)["libelle"].alias("domaine"))


@query("SELECT c_mktsegment || '@x.org' AS email, c_mktsegment AS first_name, c_name AS last_name FROM customer")
def resource_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return list_resource(_catalogue(spark, sf), "profil")


@query("""
SELECT c_name AS nom, CAST(c_custkey AS VARCHAR) AS numero_identification, 's' || c_custkey AS siret, CAST(NULL AS VARCHAR) AS email FROM customer
WHERE (lower(c_name) LIKE '%7%' OR CAST(c_custkey AS VARCHAR) LIKE '%7%') AND (lower(c_name) LIKE '%s1%' OR 's' || c_custkey LIKE '%s1%')
""")
def admin_companies(spark: SparkSession, sf: str) -> DataFrame:
    """The administration's list of companies for two words."""
    return list_resource(_catalogue(spark, sf), "admin-entreprises", "7, S1").select("nom", "numero_identification", "siret", "email")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"note\":null}' AS body FROM region")
def json_response(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as a service answers them, nulls included."""
    return response(load_table(spark, sf, "region").withColumn("note", F.lit(None).cast("string")))


@query("""
WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '12.50' WHEN 2 THEN 'none' WHEN 3 THEN '99999999999999' ELSE '-0.125' END AS montant FROM events)
SELECT CAST(event_id AS VARCHAR) AS row_key, 'decimal' AS rule, 'montant' AS field, montant AS value FROM v
WHERE TRY_CAST(montant AS DECIMAL(15,2)) IS NULL OR TRY_CAST(montant AS DECIMAL(15,2)) != TRY_CAST(montant AS DECIMAL(38,10))
""")
def decimal_violations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id") % 5
    montant = F.when(key == 0, F.col("value").cast("string")).when(key == 1, "12.50").when(key == 2, "none").when(key == 3, "99999999999999").otherwise("-0.125")
    return integrity.decimal_violations(load_table(spark, sf, "events").select("event_id", montant.alias("montant")), "montant", "event_id")


@query("""
WITH e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '@' || c_mktsegment || '.Org' WHEN 1 THEN 'No At' ELSE c_name || '@A@B.C' END AS email FROM customer)
SELECT c_custkey, CASE WHEN contains(email, '@') THEN regexp_replace(email, '[^@]*$', '') || lower(regexp_extract(email, '[^@]*$')) ELSE email END AS email FROM e
""")
def normal_emails(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    email = F.when(key == 0, F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".Org"))).when(key == 1, "No At").otherwise(F.concat("c_name", F.lit("@A@B.C")))
    return load_table(spark, sf, "customer").select("c_custkey", email.alias("email")).select("c_custkey", integrity.normal_email("email").alias("email"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment, nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_mktsegment, 'BUILDING') != '' AS given FROM customer")
def empty_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Absent texts as empty ones, and whether there was one."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return load_table(spark, sf, "customer").select("c_custkey", or_empty(segment).alias("segment"), has_text(segment).alias("given"))


@query("""
WITH u AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS file_name FROM pages)
SELECT page_id, url, file_name FROM u WHERE file_name NOT IN (SELECT file_name FROM u WHERE page_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id) = 1
""")
def manifest_whole_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The second crawler's rule: names from whole URLs, whatever the answer's status."""
    pages = load_table(spark, sf, "pages").select("page_id", "url")
    manifest = pages.where("page_id % 3 = 0").select(basename("url").alias("file_name"))
    return documents.files_to_fetch(pages, manifest, ["page_id"], "url", by_path=False, status=None).select("page_id", "url", "file_name")


@query(f"""
{LINKS_SQL}, u AS (SELECT page_id, position, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || href AS file_name, url LIKE 'https:%' AS fresh FROM l)
SELECT file_name, page_id, CAST(position AS INTEGER) AS position FROM u WHERE fresh AND file_name NOT IN (SELECT file_name FROM u WHERE NOT fresh)
QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id, position) = 1
""")
def new_links_past_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses behind the links of secure pages that no other page has but for the scheme; a Bloom filter of the latter rules most out before the exact join."""
    links = documents.extract_links(load_table(spark, sf, "pages"))
    address = F.substring_index(resolve_simple(F.col("url"), F.col("href")), "://", -1)
    links = materialize(links.select("page_id", "position", address.alias("file_name"), F.startswith(F.col("url"), F.lit("https:")).alias("fresh")), "links")
    stored = links.where("NOT fresh").select("file_name")
    # Sized by the rows there are.
    words = bloom.words_for(stored.count())
    filters = materialize(bloom.bloom_filter(stored, "file_name", words), "filter")
    first = upsert.first_wins(links.where("fresh"), ["file_name"], ["page_id", "position"])
    return bloom.missing_from(first, stored, filters, "file_name", words).select("file_name", "page_id", "position")


# Sections.

#: Sections of conversations by the words of their language; the first word of each is the title's.
LANGUAGES = (sections.Section("english", ("the", "and"), ("the", "with", " of ")), sections.Section("french", ("les", "une"), (" la ", "que", " le ")), sections.Section("german", ("der", "und"), ("sch", "ein", " die ")))


def _sections_sql() -> str:
    """The best path by a recursion over the lines, which carries for each section the best gain and path so far."""
    n = len(LANGUAGES) + 1
    has = lambda w: f"(CASE WHEN contains(lower(line), '{w}') THEN 1 ELSE 0 END)"
    inside = ["0"] + [f"2 * ({' + '.join(map(has, s.words))})" for s in LANGUAGES]
    heading = "length(trim(line, ' ')) BETWEEN 1 AND 80 AND NOT regexp_matches(trim(line, ' '), '[.;,]$')"
    begins = ["0"] + [f"((6 * ({' + '.join(map(has, s.title))})) // {len(s.title)}) * (CASE WHEN {heading} THEN 2 ELSE 1 END)" for s in LANGUAGES]
    best = f"list_transform(range(0, {n}), lambda j: list_sort(list_transform(range(0, {n}), lambda k: {{'loss': b.cur[k + 1].loss - l.e[j + 1] - (CASE WHEN j = k THEN 0 ELSE l.h[j + 1] - 8 END), 'path': b.cur[k + 1].path || chr(CAST(97 + j AS INTEGER))}}))[1])"
    start = f"list_transform(range(0, {n}), lambda j: {{'loss': CASE WHEN j = 0 THEN CAST(0 AS BIGINT) ELSE 1000000000 END, 'path': ''}})"
    names = ", ".join(f"'{s.name}'" for s in LANGUAGES)
    return f"""
WITH RECURSIVE parts AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n, [{", ".join(inside)}] AS e, [{", ".join(begins)}] AS h FROM parts),
b AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {start} AS cur FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT b.conv_id, l.n, {best} AS cur FROM b JOIN l ON l.conv_id = b.conv_id AND l.n = b.n + 1
),
p AS (SELECT conv_id, list_sort(arg_max(cur, n))[1].path AS path FROM b GROUP BY 1)
SELECT conv_id, [{names}][ascii(path[n]) - 97] AS section, CAST(min(turn) AS BIGINT) AS first_page, CAST(max(turn) AS BIGINT) AS last_page, count(*) AS n_lines
FROM l JOIN p USING (conv_id) WHERE path[n] != 'a' GROUP BY 1, 2
"""


@query(_sections_sql())
def section_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first and last page of each section of each conversation, and how many lines it has there."""
    lines = sections.section_lines(load_table(spark, sf, "conversations"), LANGUAGES, "conv_id", "turn")
    return lines.where("section IS NOT NULL").groupBy("conv_id", "section").agg(F.min("turn").alias("first_page"), F.max("turn").alias("last_page"), F.count("*").alias("n_lines"))


# Names.


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS name FROM conversations),
k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS known_name FROM benchmark)
SELECT name, known_name, CAST(levenshtein(name, known_name) AS INTEGER) AS distance FROM w JOIN k ON levenshtein(name, known_name) <= 2
""")
def near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Long words of the conversations as names, those of the benchmark as known ones."""
    words = lambda t: load_table(spark, sf, t).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("nom"))
    known = words("benchmark").select(F.lower("nom").alias("nom")).distinct().withColumn("id", F.col("nom"))
    return names.near_names(words("conversations"), known).select("name", "known_name", "distance")


# Tags and alerts.

TERMS = (("the", "english"), ("der", "german"), ("les", "french"), ("ción", "spanish"), ("license", "legal"), ("licensed under", "legal"), ("@", "contact"))


@query(f"""
WITH t(term, tag) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in TERMS)})
SELECT doc_id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM documents LEFT JOIN t ON contains(lower(text), lower(term)) GROUP BY 1
""")
def tag_by_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    tagged = alerts.find_tags(load_table(spark, sf, "documents"), spark.createDataFrame(list(TERMS), "term string, tag string"), "doc_id")
    return tagged.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("""
WITH t AS (
  SELECT DISTINCT lower(w) AS term, length(w) || ' letters' AS tag FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark)
  UNION SELECT lower(substr(text, 4, 9)), 'turn ' || turn FROM conversations
)
SELECT doc_id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM documents LEFT JOIN t ON contains(lower(text), term) GROUP BY 1
""")
def tag_by_large_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary made from two tables: words, and stretches of text with blanks and signs in them."""
    word = load_table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term"))
    stretches = load_table(spark, sf, "conversations").select(F.substring("text", 4, 9).alias("term"), F.concat(F.lit("turn "), "turn").alias("tag"))
    terms = word.select("term", F.concat(F.length("term"), F.lit(" letters")).alias("tag")).union(stretches)
    return alerts.find_tags(load_table(spark, sf, "documents"), terms, "doc_id").select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("""
SELECT DISTINCT c_custkey AS entreprise_id, l_orderkey AS publication_id FROM customer
JOIN (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1) i ON o_custkey = c_custkey
JOIN lineitem USING (l_suppkey) WHERE l_linenumber = 2
""")
def match_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of all companies and all publications."""
    lines, orders = load_table(spark, sf, "lineitem"), load_table(spark, sf, "orders")
    interests = lines.where("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entreprise_id"), F.col("l_suppkey").alias("domaine_id"))
    topics = lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("publication_id"), F.col("l_suppkey").alias("domaine_id"))
    return alerts.match_alerts(topics, interests)


# What the built-in operators offer beside, on the same tables.


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS VARCHAR) AS montant, count(*) AS n_lots, count(DISTINCT l_orderkey) AS n_marches FROM lineitem GROUP BY 1, 2
""")
def lots_by_status(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum(money("l_extendedprice")).cast("decimal(38,2)").cast("string").alias("montant")
    return load_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(total, F.count("*").alias("n_lots"), F.countDistinct("l_orderkey").alias("n_marches"))


@query("""
SELECT r_name, n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS VARCHAR) AS budget FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2
""")
def budget_by_region(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (load_table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name", "n_name").agg(F.sum(money("o_totalprice")).cast("decimal(38,2)").cast("string").alias("budget"))


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2
""")
def latest_two_by_company(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return load_table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "o_orderkey")
