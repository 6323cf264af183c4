"""The index finds what the scan finds, and reads one bucket for a run."""

import random

from tenderlake.operators.search import search
from tenderlake.operators.search_index import build_index, indexed_search


def test_indexed_search_gives_the_rows_of_the_scan(spark):
    dice = random.Random(4)
    words = ["École", "route", "PONT", "eau", "a_b", "50%", "bâtiment", "lot", "x", "construction", "\U0001f600ab"]
    rows = [(i, " ".join(dice.choice(words) for _ in range(dice.randrange(5))) if i % 9 else None, dice.choice(words), i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, titre string, source string, gram long")
    for share in (0.05, 0.5, 0.0):
        build_index(df, "id", ["titre", "source"], "index_of_test", 8, share)
        for query in ("école", "ROUTE pont", "constr eau", '"eau lot"', "truct", "x", "", None, "absent", "a_b 50%", "bâtiment, x", "ab", "\U0001f600ab", "eau\x01", "rou eco"):
            want = sorted(r.id for r in search(df, query, ["titre", "source"]).collect())
            for most in (1_000_000, 0) if query == "ROUTE pont" else (1_000_000,):
                assert sorted(r.id for r in indexed_search(df, query, "id", ["titre", "source"], "index_of_test", most).collect()) == want, (query, share)


def test_a_run_is_read_from_one_bucket(spark):
    df = spark.range(2000).selectExpr("id", "concat('name ', conv(id * 7919, 10, 36)) AS nom")
    build_index(df, "id", ["nom"], "index_of_names", 16)
    # Only so does the plan tell which buckets it reads.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plan = spark.table("index_of_names_lists").where("gram IN ('abc')")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 16" in plan
    assert spark.table("index_of_names_lists").where("gram = 'nam'").isEmpty() and not spark.table("index_of_names_runs").where("gram = 'nam'").first().listed
