import random

import numpy as np

from tenderlake.llm import components, ordinal_quality


def test_the_driver_gets_telling_features_alone(spark, monkeypatch):
    dice = random.Random(8)
    rows = [(i, " ".join(f"w{dice.randrange(3000)}" for _ in range(200)) + (" vilest" if i % 3 == 1 else ""), i % 3) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, _, k in rows], "doc_id long, quality int, toxic int")
    got, fitted = [], []
    fetch, fit = type(docs).toArrow, ordinal_quality.fit
    monkeypatch.setattr(type(docs), "toArrow", lambda df: got.append(fetch(df)) or got[-1])
    monkeypatch.setattr(ordinal_quality, "fit", lambda *a: fitted.append(a) or fit(*a))
    ordinal_quality.train(docs, labels)
    held = [ordinal_quality.buckets_of(t) for _, t, _ in rows]
    assert sum(t.nbytes for t in got) < sum(map(len, held))  # a quarter of the features' own bytes

    names, at, owner, grades = fitted[0]
    assert grades.tolist() == [k for *_, k in rows]
    judged = np.array([-1 if i % 5 == 4 else k for i, _, k in rows])
    every = sorted({b for x in held for b in x})
    has = np.array([np.isin(every, x) for x in held])
    counts, often = np.array([has[judged == k].sum(0) for k in range(3)], float), has.sum(0) >= 3
    want = np.array(every)[often & ordinal_quality.telling(np.array(every), counts, judged, 5.0)].tolist()
    assert names.tolist() == want and ordinal_quality.bucket("w vilest") in want
    assert sorted(zip(owner.tolist(), names[at].tolist(), strict=True)) == [(i, b) for i, x in enumerate(held) for b in x if b in set(want)]


def test_components_that_are_settled_cost_no_round(spark, monkeypatch):
    written = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or write(df, label))
    stars = [(0, i) for i in range(1, 40)] + [(50, 51), (52, 50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 50: 50, 51: 50, 52: 50}
    assert len(written) == 1
    chain = [(i, i + 1) for i in range(9)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(10), 0)
