import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderlake.functions.html import hrefs_parsed
from tenderlake.functions.urls import basename, resolve, resolve_simple, url_path
from tenderlake.operators import alerts, documents, integrity, nesting, ordering, upsert
from tenderlake.operators.numbering import number_rows
from tenderlake.operators.search import search, terms_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms():
    assert terms_of(' road, "new bridge" x') == ["road", "new bridge", "x"]
    assert terms_of("") == terms_of(None) == terms_of(" , ") == []


@given(st.text(alphabet="ab ,\"'", max_size=30))
def test_terms_never_hold_separators_outside_quotes(text):
    for t in terms_of(text):
        assert t and ("'" in text or '"' in text or not set(t) & set(" ,"))


def test_search_nulls_case_and_metacharacters(spark):
    df = spark.createDataFrame([(1, "Pont ÉCOLE", None), (2, None, "100% coton"), (3, "a_b", "x"), (4, None, None)], "id int, a string, b string")
    ids = lambda q: [r.id for r in search(df, q, ["a", "b"]).orderBy("id").collect()]
    assert ids("école") == [1] and ids("0%") == [2] and ids("a_b") == [3] and ids("%") == [2]
    assert ids("") == [1, 2, 3, 4] and ids("pont coton") == []


def test_ordering_drops_unknown_names_and_breaks_ties(spark):
    df = spark.createDataFrame([(3, 1), (1, None), (2, 1), (4, 5)], "id int, v int")
    get = lambda o, d=None: [r.id for r in ordering.order(df, o, ["v"], d).collect()]
    assert get("v") == [1, 2, 3, 4] and get("-v") == [4, 2, 3, 1]
    assert get("secret", "-v") == get("-v") and get("", None) == [1, 2, 3, 4]


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = number_rows(df, "n", ["k"], 5).collect()
    assert all(r.n == r.k + 5 for r in got) and len(got) == 1000
    assert number_rows(df.where("k < 0"), "n", ["k"]).count() == 0


def test_nesting_null_reference_is_null_and_childless_is_empty(spark):
    a = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id long, ref long")
    b = spark.createDataFrame([(10, None)], "key long, name string")
    got = {r.id: r.one for r in nesting.nest_one(a, b, ("ref", "key"), "one").collect()}
    assert got[1].key == 10 and got[1].name is None and got[2] is None and got[3] is None
    many = {r.id: r.kids for r in nesting.nest_many(a, b.withColumn("id", F.lit(1).cast("long")), ("id", "key"), "kids", ["key"]).collect()}
    assert many == {1: [], 2: [], 3: []}
    assert rows(nesting.nest_one(a, b, ("ref", "key"), "one", required=True).select("id")) == [(1,)]


def test_two_relations_do_not_multiply(spark):
    a = spark.createDataFrame([(1,)], "id long")
    left = spark.createDataFrame([(1, 5), (1, 6), (1, 6)], "a long, t long")
    target = spark.createDataFrame([(5, "x"), (6, "y")], "id long, n string")
    df = nesting.nest_through(a, left, target, ("id", "a"), ("t", "id"), "p", ["n"])
    df = nesting.nest_through(df, left, target, ("id", "a"), ("t", "id"), "q", ["n"])
    r = df.first()
    assert [x.n for x in r.p] == [x.n for x in r.q] == ["x", "y", "y"]


def test_get_or_create_first_wins_and_existing_stay(spark):
    old = spark.createDataFrame([(4, "a", "old")], "id long, k string, v string")
    new = spark.createDataFrame([(1, "a", "new"), (2, "b", "first"), (3, "b", "second"), (4, None, "null"), (5, None, "null2")], "at int, k string, v string")
    assert rows(upsert.get_or_create(old, new, ["k"], ["at"])) == sorted([(4, "a", "old"), (5, "b", "first"), (6, None, "null")], key=repr)
    assert rows(upsert.get_or_create(old.where("false"), new.where("false"), ["k"], ["at"])) == []


def test_replace_links_tells_null_from_empty(spark):
    bridge = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 3, 7)], "id long, l long, r long")
    asked = spark.createDataFrame([(1, None), (2, []), (3, [8, 8])], "l long, ids array<long>")
    assert rows(upsert.replace_links(bridge, asked, "l", "r", "ids")) == [(1, 1, 7), (4, 3, 8), (5, 3, 8)]


def test_add_links_ignores_known_and_null_pairs(spark):
    bridge = spark.createDataFrame([(1, 1, 7)], "id long, l long, r long")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (None, 8)], "l long, r long")
    assert rows(upsert.add_links(bridge, pairs, "l", "r")) == [(1, 1, 7), (2, 1, 8)]


def test_create_with_links(spark):
    parents = spark.createDataFrame([(3, "old")], "id long, nom string")
    bridge = spark.createDataFrame([], "id long, entreprise_id long, domaine_id long")
    asked = spark.createDataFrame([("x", [1, 2]), ("y", None)], "nom string, domaine_ids array<long>")
    table, bridges = upsert.create_with_links(parents, {"b": bridge}, asked, ["nom"], {"b": ("entreprise_id", "domaine_id", "domaine_ids")})
    assert rows(table) == [(3, "old"), (4, "x"), (5, "y")] and rows(bridges["b"]) == [(1, 4, 1), (2, 4, 2)]


def test_patch_sets_null_only_when_given(spark):
    t = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id long, x string, y string")
    c = spark.createDataFrame([(1, None, "new", ["x"]), (9, "q", "q", ["x"])], "id long, x string, y string, given array<string>")
    assert rows(upsert.patch(t, c)) == sorted([(1, None, "b"), (2, "a", "b")], key=repr)
    assert rows(upsert.patch(t, c.drop("given"), given=None)) == sorted([(1, None, "new"), (2, "a", "b")], key=repr)


def test_validation_reports(spark):
    df = spark.createDataFrame([(1, "a", "x@y.z", "1.23"), (2, "a", "nope", "1.234"), (3, None, None, "abc")], "id long, u string, mail string, money string")
    assert rows(integrity.unique_violations(df, "u", "id").select("row_key")) == [("1",), ("2",)]
    assert rows(integrity.unique_violations(df.where("id = 1"), "u", "id", df).select("row_key")) == [("1",)]
    assert rows(integrity.form_violations(df, "mail", "id", "email").select("row_key")) == [("2",)]
    assert rows(integrity.decimal_violations(df, "money", "id").select("row_key")) == [("2",), ("3",)]
    assert rows(integrity.missing_violations(df, "u", "id").select("row_key")) == [("3",)]
    assert rows(integrity.equality_violations(df, "u", "u", "id")) == []
    assert df.select(integrity.normal_email("mail").alias("m")).where("m = 'x@y.z'").count() == 1
    assert spark.createDataFrame([("A.B@X.Org",)], "m string").select(integrity.normal_email("m")).first()[0] == "A.B@x.org"


def test_urls_agree_with_the_standard_library(spark):
    from urllib.parse import urljoin

    pairs = [("https://a.org/x/y?q#f", h) for h in ("/p.pdf", "p.pdf", "//b.org/p", "http://c.org/d", "../p.pdf")] + [("https://a.org", "p.pdf"), (None, "x"), ("https://a.org/", None)]
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", resolve(F.col("b"), F.col("h")).alias("full"), resolve_simple(F.col("b"), F.col("h")).alias("simple")).collect():
        want = urljoin(r.b, r.h) if r.b and r.h else None
        assert r.full == want
        if r.b and r.h and not r.h.startswith(".."):
            assert r.simple == want
    df = spark.createDataFrame([("https://a.org/d/My%20File.pdf?x=/y",), ("https://a.org",), (None,)], "u string")
    assert [r[0] for r in df.select(basename(url_path("u"))).collect()] == ["My%20File.pdf", "", ""]


def test_parsed_links_know_other_forms(spark):
    df = spark.createDataFrame([("<A title=x HREF='a&amp;b.pdf'>x</A><a>none</a><a href=c.docx>",), (None,)], "html string")
    assert [r[0] for r in df.select(hrefs_parsed("html")).collect()] == [["a&b.pdf", "c.docx"], []]


def test_fetch_takes_the_first_good_answer_of_each_new_name(spark):
    urls = spark.createDataFrame([(1, "http://x/a.pdf", 404), (2, "http://x/d/a.pdf", 200), (3, "http://x/e/a.pdf", 200), (4, "http://x/b.pdf", 200)], "at int, file_url string, status int")
    seen = spark.createDataFrame([("b.pdf",)], "file_name string")
    assert rows(documents.files_to_fetch(urls, seen, ["at"]).select("at")) == [(2,)]
    assert rows(documents.files_to_fetch(urls, seen, ["at"], status=None).select("at")) == [(1,)]


def test_pages(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")], "doc_id long, page_no int, text string")
    assert rows(documents.trim_pages(pages).select("doc_id", "page_no")) == [(1, 1)]
    assert rows(documents.full_text(pages)) == [(1, "ac"), (2, "xy")]
    assert rows(documents.page_text(pages, 2)) == sorted([(1, "c"), (2, None)], key=repr)
    with pytest.raises(Exception, match="no page 2"):
        documents.page_text(pages, 2, strict=True).collect()
    assert rows(documents.split_pages(pages).select("doc_id", "file_name"))[:3] == [(1, "page_1.pdf"), (1, "page_2.pdf"), (1, "page_3.pdf")]
    assert spark.createDataFrame([("a.pdf.pdf",)], "n string").select(documents.text_file_name("n")).first()[0] == "a.txt.txt"


def test_tags_and_matches(spark):
    docs = spark.createDataFrame([(1, "The ROAD works"), (2, None)], "id long, text string")
    words = spark.createDataFrame([("road", "works"), ("road", "works"), ("bridge", "b")], "term string, tag string")
    assert {r.id: r.tags for r in alerts.tag_by_dictionary(docs, words).collect()} == {1: ["works"], 2: []}
    assert {r.id: r.tags for r in alerts.tag_by_words(docs, words, "id").collect()} == {1: ["works"], 2: []}
    long = spark.createDataFrame([(1, "It is licensed, under TERMS"), (2, "licensed by, under"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("licensed under", "legal"), ("under terms", "terms"), ("by", "who"), ("a b c d e f", "none"), ("", "empty"), (None, "null")], "term string, tag string")
    assert {r.id: r.tags for r in alerts.tag_by_words(long, terms, "id").collect()} == {1: ["legal", "terms"], 2: ["who"], 3: []}
    p = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "publication_id long, domaine_id long")
    c = spark.createDataFrame([(9, 5), (9, 6)], "entreprise_id long, domaine_id long")
    assert rows(alerts.match_alerts(p, c)) == [(9, 1)]


def test_date_facets(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2024-02-29'), (2, DATE '2024-02-22'), (3, DATE '2023-02-28'), (4, NULL) t(id, d)")
    ids = lambda x: [r[0] for r in rows(alerts.date_facet(df, "d", x, F.lit("2024-02-29")).select("id"))]
    assert ids("any") == [1, 2, 3, 4] and ids("today") == [1] and ids("past_7_days") == [1, 2] and ids("month") == [1, 2] and ids("year") == [1, 2]
    assert ids("null") == [4] and ids("not_null") == [1, 2, 3]


def test_two_changes_for_one_key_are_an_error(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, nom string")
    changes = spark.createDataFrame([(1, "x"), (1, "y")], "id long, nom string")
    with pytest.raises(Exception, match="several changes"):
        upsert.patch(table, changes, given=None).collect()


def test_names_are_found_or_fail(spark):
    from tenderlake.operators.lookup import find_named, first_or_none

    named = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "b")], "id int, who string")
    assert {r.id: r.found and r.found.n for r in find_named(df, named, "who", "name", "found").collect()} == {1: 2, 2: None, 3: 2}
    with pytest.raises(Exception, match="is called z"):
        find_named(spark.createDataFrame([("z",)], "who string"), named, "who", "name", "found").collect()
    assert first_or_none(named, F.col("n") > 5, ["n"]).count() == 0 and first_or_none(named, F.col("n") > 0, [F.desc("n")]).first().name == "b"


def test_tags_of_any_dictionary_by_brute_force(spark):
    import random

    dice = random.Random(2)
    signs = list("ab cde@.-%_\\É\u4e2d\U0001f600 ")
    texts = [(i, "".join(dice.choice(signs) for _ in range(dice.choice([0, 1, 2, 5, 60])))) for i in range(150)] + [(200, None), (201, "The party was artful"), (202, "the PARTY was artful")]
    cut = lambda t: t[(a := dice.randrange(len(t) + 1)) : a + dice.randrange(9)]
    terms = [(cut(dice.choice(texts)[1] or ""), f"t{dice.randrange(60)}") for _ in range(300)] + [("art", "art"), ("party was", "two"), ("@", "at"), ("absent", "no"), (None, "null"), ("x", None), ("%", "percent")]
    want = {i: sorted({g for w, g in terms if w is not None and g is not None and w.lower() in (t or "").lower()}) for i, t in texts}
    df, dictionary = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, tag string")
    for found in (alerts.find_tags(df, dictionary, "id"), alerts.find_tags(df, dictionary, "id", most=20, few=0), alerts.find_tags(df, dictionary, "id", gram=3, window=10, few=0), alerts.find_tags(df, dictionary, "id", few=1000), alerts.tag_by_dictionary(df, dictionary)):
        assert {r.id: r.tags for r in found.collect()} == want
    twice = alerts.tag_by_dictionary(df.union(df), dictionary)
    assert twice.count() == 2 * len(texts) and twice.columns == ["id", "text", "tags"]
    for few in (0, 200):
        assert {r.id: r.tags for r in alerts.find_tags(df, dictionary.where("false"), "id", few=few).collect()} == {i: [] for i, _ in texts}
        shared = alerts.find_tags(df.withColumn("id", F.col("id") % 3), dictionary, "id", few=1000 if few else 0).collect()
        assert {r.id: r.tags for r in shared} == {k: sorted({t for i, _ in texts if i % 3 == k for t in want[i]}) for k in range(3)}
    assert alerts.find_tags(df.where("false"), dictionary, "id").count() == 0


def test_a_dictionary_of_100000_terms(spark):
    """Terms are looked for in the plan's join, none in the plan itself."""
    terms = spark.range(100_000).select(F.concat(F.lit("term "), F.conv(F.col("id").cast("string"), 10, 36), F.lit(".")).alias("term"), F.col("id").cast("string").alias("tag"))
    texts = spark.range(300).select("id", F.concat(F.lit("xTERM "), F.conv((F.col("id") * 331).cast("string"), 10, 36), F.lit(". and more")).alias("text"))
    found = alerts.find_tags(texts, terms, "id")
    assert {r.id: r.tags for r in found.collect()} == {i: [str(i * 331)] for i in range(300)}


def test_names_within_two_edits_by_brute_force(spark):
    import random

    from tenderlake.operators import names

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    dice = random.Random(6)
    word = lambda: "".join(dice.choice("ab é\U0001f600c") for _ in range(dice.choice([0, 1, 2, 3, 9, 10, 11, 12, 25])))
    known = [(i, word()) for i in range(120)]

    def changed(t):
        for _ in range(dice.randrange(4)):
            i = dice.randrange(len(t) + 1)
            t = dice.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "b" + t[i + 1 :]])
        return t

    asked = [changed(dice.choice(known)[1]) for _ in range(150)] + ["  ALPHA   sarl", None] + ["Societe generale " + str(i) for i in range(5)]
    known += [(500, "Alpha SARL"), (501, "alpha sarl"), (502, None)] + [(600 + i, "societe generale " + "y" * i) for i in range(5)]
    clean = lambda t: " ".join(t.lower().split())
    want = {(clean(a), i, b, distance(clean(a), clean(b))) for a in asked if a is not None for i, b in known if b is not None and distance(clean(a), clean(b)) <= 2}
    a, k = spark.createDataFrame([(t,) for t in asked], "nom string"), spark.createDataFrame(known, "id long, nom string")
    for prefix in (10, 4):
        got = [tuple(r) for r in names.near_names(a, k, prefix=prefix).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    best = {}
    for name, i, _, d in want:
        best[name] = min(best.get(name, (9, 0)), (d, i))
    found = names.resolve_names(a, k).collect()
    assert len(found) == len(asked) and all(r.known_id == (best.get(clean(r.nom), (0, None))[1] if r.nom is not None else None) for r in found)


def test_matches_of_publications_with_the_same_topics_are_told_apart_once(spark):
    """The pairs themselves aren't dealt out again: what a shuffle gets is counted in the plan that has run."""
    p = spark.range(400).select(F.col("id").alias("publication_id"), F.explode(F.expr("IF(id % 4 = 0, array(1L, 2L), array(id % 3, id % 3))")).alias("domaine_id"))
    c = spark.range(300).select(F.col("id").alias("entreprise_id"), F.explode(F.expr("array(id % 5, (id + 1) % 5, null)")).alias("domaine_id"))
    found = alerts.match_alerts(p, c)
    want = {(a, b) for a, ta in ((i, {i % 5, (i + 1) % 5}) for i in range(300)) for b, tb in ((i, {1, 2} if i % 4 == 0 else {i % 3}) for i in range(400)) if ta & tb}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    for few in (0, 1):
        wide = [tuple(r) for r in alerts.match_alerts(p, c, wide=few).collect()]
        assert len(wide) == len(want) and set(wide) == want
    last = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in last[: next(i for i, line in enumerate(last) if "Join" in line)])


def test_a_large_dictionary_leaves_the_texts_where_they_are(spark):
    """Texts aren't multiplied by their runs; terms with one beginning, terms in another's middle and several tags of a term are found."""
    terms = [(f"https://example.org/notice/{i:05}", f"t{i % 7}") for i in range(3000)] + [("https://example.org/notice/00001", "other"), ("0000", "zeros"), ("ü", "short"), ("notice/00002 and a long end of more than sixteen bytes", "long")]
    texts = [(1, "see HTTPS://example.org/notice/00001"), (2, "https://example.org/notice/00002 and a long end of more than sixteen bytes."), (3, "https://example.org/notice/0000"), (4, "Ü"), (5, ""), (6, None), (7, "1" * 5000)]
    want = {1: ["other", "t1", "zeros"], 2: ["long", "t2", "zeros"], 3: ["zeros"], 4: ["short"], 5: [], 6: [], 7: []}
    df, dictionary = spark.createDataFrame(texts, "id long, text string").coalesce(1), spark.createDataFrame(terms, "term string, tag string")
    for more in ({}, {"window": 7}, {"most": 500, "gram": 5}):
        found = alerts.find_tags(df, dictionary, "id", **more)
        assert {r.id: r.tags for r in found.collect()} == want
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
