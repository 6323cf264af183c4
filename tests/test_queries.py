"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tenderlake.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else v
    return sorted((tuple(clean(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_alerts_of_all_companies_and_publications(spark):
    """By brute force, without any thinning of either side."""
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_suppkey", "l_linenumber"])
    company = dict(pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey"]).itertuples(index=False))
    followers, want = {}, set()
    for order, supplier, _ in lines[lines.l_linenumber == 1].itertuples(index=False):
        if order in company:
            followers.setdefault(supplier, set()).add(company[order])
    for order, supplier, _ in lines[lines.l_linenumber == 2].itertuples(index=False):
        want |= {(c, order) for c in followers.get(supplier, ())}
    got = [(r.entreprise_id, r.publication_id) for r in QUERIES["match_alerts"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(c % 10 and p % 10 for c, p in got)


def test_entry_has_rows_and_sql_for_each_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "date_publication", "source"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """What is left after the operators and their pipeline are taken away must still import."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'publication_list' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_workers_find_the_package_in_a_session_that_was_there_before(tmp_path):
    """Started elsewhere, before the entry is imported, without a path to the repository."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
q = entry.queries()
for name in ("crawl_document_urls", *(n for n in q if n.startswith(("op6_", "op12_")))):
    assert q[name](spark, {SF!r}).count() >= 0, name
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, env=env)
