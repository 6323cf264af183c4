import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tenderlake.llm import similar_sets
from tenderlake.sources import tables


def test_long_documents_that_share_a_passage_are_told_apart_without_their_sets(spark, monkeypatch):
    dice = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(450))
    texts = [f"{passage} " + " ".join(f"w{dice.randrange(10**6)}" for _ in range(dice.randrange(900, 1100))) for _ in range(40)]
    texts.append(texts[0] + " and some more words at its end")
    held = []
    write = similar_sets.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "held-sets":
            held.append(out.count())
        return out

    monkeypatch.setattr(similar_sets, "materialize", counted)
    found = similar_sets.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 0 if i == 40 else i for i in range(41)}
    assert max(held) <= 2  # the near copy and its original


def test_wide_sketches_never_differ_in_more_than_the_sets():
    dice = np.random.default_rng(4)
    pool = dice.integers(-(2**63), 2**63 - 1, 12_000, np.int64)
    sets = [np.unique(dice.choice(pool, n, replace=False)) for n in (513, 600, 1024, 1025, 3000, 9000)]
    a, b = zip(*((x, y) for x in sets for y in sets), strict=True)
    got = similar_sets.differing_bits([similar_sets.wide_sketch_of(x) for x in a], [similar_sets.wide_sketch_of(y) for y in b])
    assert all(d <= len(np.setxor1d(x, y)) for d, x, y in zip(got.tolist(), a, b, strict=True))
    assert all((d == 0) == (x is y) for d, x, y in zip(got.tolist(), a, b, strict=True))
    assert similar_sets.wide_sketch_of(sets[0][:512]) is None


def test_shuffle_files_go_once_a_table_is_written(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(tables.CLEAN_UP)
    tables.materialize(spark.range(1000).groupBy(F.col("id") % 7).agg(F.collect_list("id").alias("ids")), "grouped")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(tables.CLEAN_UP) == setting
