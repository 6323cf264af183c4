"""License scan, periodic runs and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tenderlake.llm import license_scan as L
from tenderlake.llm import periodic_runs as P
from tenderlake.llm import ranked_search as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "no id"), (None, "no id"), (4, "-- !! .."), (5, "É à 日本 \U0001f600 x"), (6, "one"), (7, "a b"), (8, "same"), (8, "same")]


def table(spark, rows, extra=True):
    """With columns whose names clash with those that the operators use."""
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n long, row string")
    return df if extra else df.select("doc_id", "text")


# License scan.


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base_places(text):
    words, starts, labels = license_words(text), [], set()
    for label, phrase in L.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def scanned(spark, rows):
    return L.label_licenses(L.scan_licenses(table(spark, rows), L.template_table(spark))).collect()


def test_places_of_phrases_are_those_of_brute_force(spark):
    dice = random.Random(3)
    bits = "under the mit license apache version 2 cc by nc mit, MIT Under-the 2.0 ée x".split()
    rows = [(i, " ".join(dice.choice(bits) for _ in range(dice.randrange(60)))) for i in range(300)]
    rows += [(900, "under the mit license " * 400), (901, "cc by nc cc by nc"), (902, "CC-BY-NC\0by"), *ODD]
    got = scanned(spark, rows)
    have = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert have == Counter((i, *base_places(t)) for i, t in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert sum(r.n_base for r in got) > 400


def test_notices_are_found_in_spite_of_changed_words(spark):
    words = dict(L.NOTICES)["bsd"].split()
    changed = words[:6] + ["really"] + words[6:11] + words[12:]
    prose = "it was the best of times and it was the worst of times".split()
    rows = [(1, " ".join(prose + words + prose)), (2, " ".join(prose + changed + prose)), (3, " ".join(words[:8] + prose + words[14:])), (4, " ".join(prose * 50)), (5, " ".join(reversed(words)))]
    got = {r.doc_id: r for r in scanned(spark, rows)}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "bsd", "", "", ""]
    assert got[1].score == 1 > got[2].score >= 0.8 > got[3].score > got[4].score == got[5].score == 0
    spans = L.scan_licenses(table(spark, rows[:1]), L.template_table(spark)).first().spans
    assert [(s.first_word, s.last_word) for s in spans if s.label == "bsd"] == [(len(prose), len(prose) + len(words) - 1)]


def test_templates_beyond_the_bound_are_joined_by_shuffle(spark):
    rows = [(1, "Released under the MIT License"), *ODD]
    one = L.scan_licenses(table(spark, rows), L.template_table(spark)).collect()
    other = L.scan_licenses(table(spark, rows), L.template_table(spark), most=1).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, other)) and len(one) == len(rows)


def test_license_scan_of_odd_tables(spark):
    assert scanned(spark, []) == []
    with pytest.raises(Exception, match="fewer than 3 words"):
        L.scan_licenses(table(spark, ODD), L.template_table(spark, (("x", "two words"),), ())).collect()


# Periodic runs.


def brute_runs(w, least=6, times=4):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, times * q):
                out.setdefault((s, s + size), q)
    return sorted((s, e, q) for (s, e), q in out.items())


def odd_words(dice):
    a = dice.choice([1, 2, 3, 5, 50])
    w = [dice.randrange(a) for _ in range(dice.randrange(0, 40))]
    for _ in range(dice.randrange(6)):
        block, m = [dice.randrange(a) for _ in range(dice.randrange(1, 9))], dice.randrange(1, 10)
        w += (block * m)[: dice.randrange(len(block) * m) + 1] + [dice.randrange(a) for _ in range(dice.randrange(0, 6))]
    return w


def test_runs_are_those_of_brute_force():
    dice = random.Random(11)
    for _ in range(400):
        docs = [odd_words(dice) for _ in range(dice.randrange(1, 8))]
        sizes = [len(d) for d in docs]
        words = np.array([x for d in docs for x in d], np.int64)
        got = [tuple(r) for r in P.find_runs(words, np.repeat(np.arange(len(docs)), sizes)).tolist()]
        want, at = [], 0
        for d in docs:
            want += [(s + at, e + at, q) for s, e, q in brute_runs(d)]
            at += len(d)
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("words", [[0] * 300_000, list(range(500)) * 600, ([0, 1, 2] * 4 + [3]) * 20_000], ids=["one word", "long period", "runs in runs"])
def test_very_long_texts_take_seconds(words):
    found = P.find_runs(np.array(words), np.zeros(len(words), np.int64)).tolist()
    assert [0, len(words)] in [r[:2] for r in found]
    for s, e, q in found[:200]:
        assert words[s : e - q] == words[s + q : e] and (s == 0 or s + q > len(words) or words[s - 1] != words[s - 1 + q])


def test_report_of_runs_by_brute_force(spark):
    dice = random.Random(5)
    # Ids whose check sum makes every tenth text repeat are among these.
    rows = [(i, " ".join(f"w{x}" for x in odd_words(dice)) if i % 3 else " ".join(f"u{dice.randrange(10**6)}" for _ in range(dice.randrange(200)))) for i in range(250)] + ODD
    made = P.report_runs(P.collapse_runs(table(spark, rows), change=P.periodic)).collect()
    want = []
    for i, text in rows:
        w = P.periodic(re.findall(r"[^\x20\x09-\x0D]+", text or ""), i)
        runs = brute_runs(w)
        keep = [True] * len(w)
        for s, e, q in runs:
            keep[s + q : e] = [False] * (e - s - q)
        top = min(((s - e, s, q) for s, e, q in runs), default=None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
        left = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        want.append((i, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert Counter(tuple(r) for r in made) == Counter(want)
    assert sum(r.n_runs > 0 for r in made) > 50
    assert P.collapse_runs(table(spark, [])).count() == 0


def test_every_tenth_document_repeats():
    words = [b"w%d" % i for i in range(97)]
    changed = [i for i in range(1000) if P.periodic(words, i) != words]
    assert 60 < len(changed) < 140
    out = P.periodic(words, changed[0])
    assert len(out) == 97 and out[: P.zlib.crc32(str(changed[0]).encode()) // 10 % 97] == words[: P.zlib.crc32(str(changed[0]).encode()) // 10 % 97]


# Ranked search.


def brute_search(docs, queries, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    frequency = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, queries, **more):
    items = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, rank int")
    df = R.rank_documents(table(spark, docs), items, **more)
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranks_are_those_of_brute_force(spark, monkeypatch):
    dice = random.Random(7)
    vocabulary = [f"t{int(dice.paretovariate(0.6))}" for _ in range(500)]
    docs = [(i, " ".join(dice.choice(vocabulary) for _ in range(dice.choice([0, 3, 20, 200])))) for i in range(900)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)] + ODD[:2] + ODD[5:8]  # ties
    dice.shuffle(docs)
    queries = [(i, " ".join(dice.choice(vocabulary) for _ in range(dice.choice([0, 1, 4, 40])))) for i in range(40)] + [(50, None), (51, "T1 t1, T1"), (51, "t2"), (None, "t3 É"), (52, "absent")]
    want = brute_search(docs, queries)
    assert found(spark, docs, queries) == want
    assert found(spark, docs, queries, group_chars=50) == want  # many groups of queries
    assert len(want) > 300


def test_intervals_are_split_down_to_the_best_documents():
    """With leaves of one document nothing but bounds and splits finds the ten best."""
    dice = np.random.default_rng(4)
    for trial in range(30):
        documents, size = 400, 12
        dense = np.where(dice.random((documents, size)) < 0.3, dice.integers(0, 6 if trial % 2 else 1000, (documents, size)), 0)
        owner, terms = np.nonzero(dense)
        ids = dice.permutation(10 * documents)[:documents]
        block = R.Block(ids, terms, owner, dense[owner, terms])
        for asked in (np.arange(size), np.array([1]), np.array([3, 7])):
            scores = dense[:, asked].sum(axis=1)
            want = sorted(((int(s), -int(i)) for s, i in zip(scores, ids, strict=True) if s > 0), reverse=True)[:10]
            for leaf in (1, 128):
                best: list = []
                R.LEAF, kept = leaf, R.LEAF
                block.search(asked, 10, best)
                R.LEAF = kept
                assert sorted(best, reverse=True) == want


def test_search_of_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "a")]) == []
