"""The pipeline's stages one after another on awkward rows, each against brute force on its own input."""

import random
import re

import corpus_pipeline
import pytest
from tenderlake.llm import packing, secret_scan
from tenderlake.sources.tables import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, body string, mark long, node int, n long"


def make_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [[word() for _ in range(120)] for _ in range(20)]
    near = [w[:60] + [word()] + w[61:] for w in texts[:5]]
    bodies = [" ".join(w) for w in texts + near + texts[5:8]]
    bodies[19] += " token = abcdefgh12345678"
    bodies += ["  ".join(texts[9]), None, "", " \n", "word " * 30_000]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(bodies)]
    rows += [(None, "a text without an id", None, None, None), (3, bodies[3], None, "s", 1)]
    return [(*r, "k", "b", 1, 2, 3) for r in rows]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(make_rows(), COLUMNS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, None), (2, None, None)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    functions = dict(corpus_pipeline.STAGES)
    now = docs
    for name in ("quality", "exact dedup", "near dedup", "secrets"):
        after = materialize(functions[name](spark, now, f"file://{tmp_path}"), "stage")
        assert after.columns == docs.columns
        before, rows = now.collect(), after.collect()
        if name == "quality":  # all rated ones are good, so nothing speaks against any
            assert len(rows) == len(before)
        elif name == "exact dedup":
            bare = lambda r: re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")
            groups = {}
            for r in before:
                groups.setdefault(bare(r), []).append(r)
            want = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
            assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in want)
        elif name == "near dedup":
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            alike = lambda x, y: 5 * len(sets(x.text) & sets(y.text)) >= 4 * len(sets(x.text) | sets(y.text))
            assert gone == {r.doc_id for r in before if r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and alike(o, r) for o in before)}
        else:
            scanner = secret_scan.EntropyScanner(secret_scan.EntropyRules())
            assert len(rows) == len(before) and not any(secret_scan.scan_text(r.text or "", scanner)[0] for r in rows)
            assert sum("[SECRET]" in (r.text or "") for r in rows) == 1
        now = after
    pieces = functions["packing"](spark, now, f"file://{tmp_path}").toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= packing.SEQUENCE
    assert len(pieces[pieces["piece"] == 0]) == now.count()
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").toPandas()
    assert sorted(whole["ids_crc32"]) == sorted(pieces["ids_crc32"])


@pytest.mark.parametrize("rated", [0, 1])
def test_empty_tables(spark, tmp_path, rated):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)][:rated], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
