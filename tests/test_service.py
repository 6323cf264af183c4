"""The catalogue end to end: payloads in, nested records out, deletions, storage, streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import integrity
from tenderlake.plans.ingest import save_payloads, store_payloads
from tenderlake.plans.resources import RESOURCES, detail, list_resource, response
from tenderlake.schemas import PAYLOAD, TABLES
from tenderlake.sources.files import list_files, parse_payloads, read_config, read_text_pages, to_json_rows, write_pages, write_texts
from tenderlake.sources.generator import companies
from tenderlake.sources.store import Store

BATCH = [
    {
        "arrival": 1,
        "entreprise": {"nom": "Alpha", "siret": "1", "domaines": ["BTP", "Eau", "BTP"], "secteurs": ["Public"]},
        "domaine": "BTP",
        "type_procedure": "Ouvert",
        "publication": {"numero": "P1", "titre": "Quotidien 1", "date_publication": "2024-01-02", "source": "DG"},
        "marche": {"objet": "Route", "region": "Centre", "budget_min": 10.5},
        "lots": [{"numero_lot": 2, "description": "deux"}, {"numero_lot": 1, "description": "un"}, {"numero_lot": 1, "description": "again"}],
        "resultat": {"montant_attribue": 99.99},
        "alerte": {"type_alerte": "info", "contenu_alerte": "texte", "canal_alerte": "mail"},
    },
    {"arrival": 2, "entreprise": {"nom": "Alpha", "siret": "other"}, "publication": {"numero": "P1", "titre": "late"}, "marche": {"objet": "Pont"}, "domaine": "Eau", "alerte": {"type_alerte": "x"}},
    {"arrival": 3, "publication": {"numero": "P2", "titre": "Quotidien 2", "date_publication": "2024-03-02"}, "marche": {"objet": "École"}, "resultat": {}, "alerte": {"type_alerte": "nobody"}},
]


@pytest.fixture(scope="module")
def empty(spark):
    return {n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()}


@pytest.fixture(scope="module")
def saved(spark, empty):
    body = spark.createDataFrame([(json.dumps(p),) for p in BATCH], "body string")
    return save_payloads(empty, parse_payloads(body), F.lit("2024-05-01 00:00:00"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_payloads_become_rows_once(saved):
    assert rows(saved["entreprise"], "id", "nom", "siret", "adresse") == [(1, "Alpha", "1", "")]
    assert rows(saved["domaine"], "id", "libelle") == [(1, "BTP"), (2, "Eau")]
    assert rows(saved["entreprise_domaine"], "entreprise_id", "domaine_id") == [(1, 1), (1, 2)]
    assert rows(saved["publication"], "id", "numero", "titre") == [(1, "P1", "Quotidien 1"), (2, "P2", "Quotidien 2")]
    assert rows(saved["publication_domaine"], "publication_id", "domaine_id") == [(1, 1), (1, 2)]
    assert rows(saved["marche"], "publication_id", "objet") == [(1, "Pont"), (1, "Route"), (2, "École")]
    assert rows(saved["lot"], "numero_lot", "description") == [(1, "un"), (2, "deux")]
    assert len(rows(saved["resultat"], "marche_id")) == 2
    assert rows(saved["alerte"], "type_alerte") == [("info",), ("x",)]


def test_a_batch_saved_twice_adds_only_alerts(spark, saved):
    body = spark.createDataFrame([(json.dumps(p),) for p in BATCH], "body string")
    again = save_payloads(saved, parse_payloads(body), F.lit("2024-05-01 00:00:00"))
    for name in TABLES:
        assert again[name].count() == saved[name].count() * (2 if name == "alerte" else 1), name


def test_every_resource_lists_and_details(spark, saved):
    for name in RESOURCES:
        list_resource(saved, name, "x" if RESOURCES[name].search else None).collect()
        assert detail(saved, name, 12345).count() == 0
    assert [r.numero for r in list_resource(saved, "publications").collect()] == ["P2", "P1"]
    assert [r.numero for r in list_resource(saved, "publications", ordering="date_publication").collect()] == ["P1", "P2"]
    assert [r.objet for r in list_resource(saved, "marches", "ÉCOLE").collect()] == ["École"]
    r = list_resource(saved, "resultats", "alpha").first()
    assert r.marche.objet == "Route" and [d.libelle for d in r.marche.publication.domaines] == ["BTP", "Eau"] and r.entreprise_attributaire.nom == "Alpha"
    assert [x.numero_lot for x in r.marche.lots] == [2, 1] and r.marche.type_procedure.libelle == "Ouvert"
    assert list_resource(saved, "resultats", "école").first().entreprise_attributaire is None
    assert json.loads(response(detail(saved, "marches", 1)).first()[0])["publication"]["numero"] == "P1"


def test_tenders_are_contracts_with_more_columns(spark, saved):
    t = dict(saved)
    t["appel_offre"] = spark.createDataFrame([(1, datetime.date(2024, 1, 5), "REF", "Ouaga", None, None, None, None)], TABLES["appel_offre"].schema)
    r = list_resource(t, "appels-offres", "ouaga", "-dateDepot").first()
    assert r.id == 1 and r.referenceDossier == "REF" and r.publication.numero == "P1"


def test_deletion_reaches_three_levels_and_nulls_references(spark, saved):
    after = integrity.delete(saved, "publication", saved["publication"].where("numero = 'P1'").select("id"))
    assert [after[n].count() for n in ("publication", "marche", "lot", "resultat", "alerte", "publication_domaine")] == [1, 1, 0, 1, 0, 0]
    after = integrity.delete(saved, "entreprise", saved["entreprise"].select("id"))
    assert after["entreprise"].count() == after["alerte"].count() == after["entreprise_domaine"].count() == 0
    assert after["resultat"].count() == 2 and after["resultat"].where("entreprise_attributaire_id IS NOT NULL").count() == 0


def test_validation_of_a_table(spark, saved):
    new = spark.createDataFrame([(7, 99, None, "Objet"), (8, 1, 55, None)], "id long, publication_id long, type_procedure_id long, objet string")
    found = rows(integrity.validate("marche", new, saved), "row_key", "rule", "field")
    assert found == [("7", "reference", "publication_id"), ("8", "reference", "type_procedure_id"), ("8", "required", "objet")]
    doubled = spark.createDataFrame([(5, "BTP")], "id long, libelle string")
    assert rows(integrity.validate("domaine", doubled, saved), "rule", "field") == [("unique", "libelle")]


def as_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("most", [1_000_000, 0], ids=["broadcast", "by bucket"])
def test_stored_tables_get_new_rows_only(spark, empty, saved, most):
    """As the plans have it, twice; what is stored stays in its files."""
    store = Store(spark, f"stored_{most}", buckets=4, most=most)
    body = lambda batch: parse_payloads(spark.createDataFrame([(json.dumps(p),) for p in batch], "body string"))
    now = F.lit("2024-05-01 00:00:00")
    store_payloads(store, body(BATCH), now, "first")
    for name in ("entreprise", "lot", "alerte"):
        assert as_rows(store.table(name)) == as_rows(saved[name]), name
    files = {name: set(store.table(name).inputFiles()) for name in TABLES}
    more = [
        {"arrival": 1, "entreprise": {"nom": "Beta", "siret": "2", "domaines": ["Eau", "Sol"]}, "publication": {"numero": "P1"}, "marche": {"objet": "Route"}, "lots": [{"numero_lot": 1}, {"numero_lot": 3}], "resultat": {}, "alerte": {"type_alerte": "y"}},
        {"arrival": 2, "entreprise": {"nom": None, "siret": "0"}, "publication": {"numero": "P9"}},
        {"arrival": 3, "entreprise": {"nom": None, "siret": "1"}, "publication": {"numero": "P9"}},
    ]
    want = save_payloads(saved, body(more), now)
    for _ in range(2 if most else 1):  # the second time as after a failure
        store_payloads(store, body(more), now, "second")
    for name in TABLES:
        columns = [c for c in store.table(name).columns if c != "id" or name != "alerte"]  # a batch that is repeated numbers its alerts anew
        assert as_rows(store.table(name).select(*columns)) == as_rows(want[name].select(*columns)), name
        assert files[name] <= set(store.table(name).inputFiles()), name
    added = {name: set(store.table(name).inputFiles()) - files[name] for name in TABLES}
    counts = {name: spark.read.parquet(*sorted(a)).count() if a else 0 for name, a in added.items()}
    assert counts == {name: want[name].count() - saved[name].count() for name in TABLES}
    assert counts["entreprise"] == 2 and counts["alerte"] == 1 and counts["resultat"] == 0


def test_a_stored_table_is_met_without_a_shuffle(spark):
    """Only the batch's keys are exchanged, to as many partitions as there are buckets."""
    store = Store(spark, "stored_plan", buckets=5, most=0)
    keys = spark.createDataFrame([(i, f"o{i}") for i in range(20)], "publication_id long, objet string")
    plan = store._meeting("marche", keys)._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("ShuffledHashJoin") :].split("Union")[0]
    lines = joined.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    assert not any("Exchange" in x for x in lines[: scan + 1])
    assert sum("Exchange hashpartitioning" in x and ", 5)" in x for x in lines) == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo\f")
    (tmp_path / "in/b.bin").write_text("no")
    files = list_files(spark, f"file://{tmp_path}/in", ".txt")
    assert rows(read_text_pages(files), "page_no", "text") == [(0, "one"), (1, "two"), (2, "")]
    df = spark.createDataFrame([("a.pdf", 1, "t")], "file_name string, doc_id int, text string")
    for _ in range(2):
        write_texts(df, f"file://{tmp_path}/texts")
        write_pages(df, f"file://{tmp_path}/pages")
    assert rows(spark.read.parquet(f"file://{tmp_path}/texts"), "file_name", "text") == [("a.txt", "t")]
    assert spark.read.parquet(f"file://{tmp_path}/pages").count() == 1
    assert json.loads(to_json_rows(df.withColumn("n", F.lit(None).cast("int"))).first()[0])["n"] is None
    assert read_config(str(tmp_path / "none.yaml")) is None
    (tmp_path / "c.yaml").write_text("a: {role: x}")
    assert read_config(str(tmp_path / "c.yaml")) == {"a": {"role": "x"}}


def test_generator_is_seeded_and_unique(spark):
    make = lambda seed: companies(spark, 50, seed, datetime.date(2024, 1, 1), ["a", "b", "c", "d"], ["s"], ["N 1", "N 2"])
    one, same, other = make(1).collect(), make(1).collect(), make(2).collect()
    assert one == same and one != other
    assert len({r.siret for r in one}) == len({r.numero_identification for r in one}) == 50 and one[0].numero_identification == "IDBURK1000"
    assert all(1 <= len(r.domaines) <= 3 and len(set(r.domaines)) == len(r.domaines) and r.secteurs == ["s"] for r in one)


def test_streams(spark, tmp_path):
    from tenderlake.streaming.ingest import interest_stream, payload_stream, save_stream, windowed_counts

    landing = tmp_path / "landing"
    landing.mkdir()
    store = Store(spark, "streamed", buckets=2)
    for i in (0, 1):
        (landing / f"{i}.json").write_text("\n".join(json.dumps(p) for p in BATCH))
        save_stream(payload_stream(spark, f"file://{landing}"), store, f"file://{tmp_path}/cp").awaitTermination()
        assert store.table("marche").count() == 3 and store.table("alerte").count() == 2 * (i + 1)  # alerts are inserted whenever they come
    spark.createDataFrame([(1, 5, datetime.datetime(2024, 1, 1)), (1, 5, datetime.datetime(2024, 1, 1, 0, 5))], "publication_id long, domaine_id long, ts timestamp").write.parquet(f"file://{tmp_path}/pubs")
    stream = spark.readStream.schema("publication_id long, domaine_id long, ts timestamp").parquet(f"file://{tmp_path}/pubs")
    firms = spark.createDataFrame([(9, 5)], "entreprise_id long, domaine_id long")
    q = interest_stream(stream, firms).writeStream.format("memory").queryName("interests").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("interests").count() == 1
    counts = windowed_counts(stream.withColumn("event_type", F.lit("e")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [2]
    assert PAYLOAD


def test_companies_are_created_changed_and_removed_by_request(spark, saved):
    from tenderlake.plans.writes import change, create, remove

    company = "arrival long, nom string, numero_identification string, siret string, email string, repprenom string, domaine_ids array<long>, secteur_ids array<long>"
    requests = spark.createDataFrame(
        [
            (1, "Beta", "N2", "2", "b@example.org", "p", [2, 2, 1], []),
            (2, "Gamma", "N3", "2", None, "p", [1], None),  # siret of 1
            (3, "Delta", "N3", "3", None, "p", None, None),  # free, as 2 is refused
            (4, "Echo", "N4", "1", None, "p", None, None),  # siret that is stored
            (5, None, "N5", "5", "no address", "p", [99], [1]),
            (6, "Foxtrot", "N6", "x" * 21, "", "p", [1], [1]),
            (7, "Golf", "N2", "7", None, "p", None, None),  # number of 1
        ],
        company,
    )
    made = create(saved, "entreprise", requests)
    assert rows(made.tables["entreprise"], "id", "nom") == [(1, "Alpha"), (2, "Beta"), (3, "Delta")]
    assert rows(made.tables["entreprise_domaine"].where("entreprise_id > 1"), "entreprise_id", "domaine_id") == [(2, 1), (2, 2), (2, 2)]
    assert rows(made.refused, "row_key", "rule", "field") == [
        ("2", "unique", "siret"), ("4", "unique", "siret"), ("5", "email", "email"), ("5", "reference", "domaine_ids"), ("5", "required", "nom"), ("6", "max_length", "siret"), ("7", "unique", "numero_identification"),
    ]

    changes = spark.createDataFrame(
        [
            (1, 2, "Beta 2", "2", [], ["nom", "siret"]),  # its own siret
            (2, 3, None, "1", None, ["siret"]),  # another's
            (3, 99, "x", "9", None, ["nom"]),
            (4, 2, "again", "9", None, ["nom"]),
            (5, 1, None, "8", [2], ["siret"]),  # nom isn't set
        ],
        "arrival long, id long, nom string, siret string, domaine_ids array<long>, given array<string>",
    )
    changed = change(made.tables, "entreprise", changes)
    assert rows(changed.tables["entreprise"], "id", "nom", "siret") == [(1, "Alpha", "8"), (2, "Beta 2", "2"), (3, "Delta", "3")]
    assert rows(changed.tables["entreprise_domaine"], "entreprise_id", "domaine_id") == [(1, 2)]
    assert rows(changed.refused, "row_key", "rule") == [("2", "unique"), ("3", "unknown"), ("4", "one change for a key")]
    whole = change(made.tables, "entreprise", changes.where("arrival IN (1, 2, 3)").drop("given"), None)
    assert rows(whole.refused, "row_key", "rule", "field") == [("2", "required", "nom"), ("3", "unknown", "id")]

    gone = remove(changed.tables, "entreprise", spark.createDataFrame([(1, 1), (2, 1), (3, 77)], "arrival long, id long"))
    assert rows(gone.tables["entreprise"], "id") == [(2,), (3,)] and gone.tables["alerte"].count() == 0
    assert rows(gone.refused, "row_key", "value") == [("2", "1"), ("3", "77")]
    award = create(saved, "resultat", spark.createDataFrame([(1, 1, "r"), (2, 2, "r"), (3, 2, "s"), (4, 50, "t")], "arrival long, marche_id long, reference_decision string"))
    assert rows(award.refused, "row_key", "rule") == [("1", "unique"), ("3", "unique"), ("4", "reference")]
    assert award.tables["resultat"].count() == 3
    none = create(saved, "domaine", spark.createDataFrame([], "arrival long, libelle string"))
    assert none.tables["domaine"].count() == 2 and none.refused.count() == 0


def test_requests_take_unique_values_in_turn(spark):
    """Against one loop over the requests."""
    import random

    from tenderlake.plans.writes import take_in_turn

    dice = random.Random(5)
    claims = [(i, f, str(dice.randrange(40))) for i in range(120) for f in ("a", "b")]
    held = [("a", "3"), ("b", "5")]
    taken, want = set(held), set()
    for i in range(120):
        mine = {(f, v) for j, f, v in claims if j == i}
        if mine & taken:
            want.add(str(i))
        else:
            taken |= mine
    got = take_in_turn(spark.createDataFrame(claims, "arrival long, field string, value string"), spark.createDataFrame(held, "field string, value string"))
    assert {r.row_key for r in got.collect()} == want and len(want) < 120


def test_one_pass_settles_as_rounds_do(spark):
    """The same claims are lost, chains of requests that block each other among them."""
    import random

    from tenderlake.plans.writes import take_in_turn

    dice = random.Random(7)
    claims = [(i, f, str(dice.randrange(12))) for i in range(40) for f in ("a", "b", "c")] + [(100 + i, f, f"x{i + (f == 'b')}") for i in range(9) for f in ("a", "b")] + [(200 + i, "d", f"y{(i + k) // 2}") for i in range(10) for k in (0, 1)]
    df, held = spark.createDataFrame(sorted(set(claims), key=str), "arrival long, field string, value string"), spark.createDataFrame([("a", "3")], "field string, value string")
    rounds, once = (sorted(map(tuple, take_in_turn(df, held, few).collect())) for few in (0, 1000))
    assert rounds == once and len(once) > 20
    long = [(i, "d", f"z{i + k}") for i in range(4000) for k in (0, 1)]
    assert take_in_turn(spark.createDataFrame(long, df.schema), held).count() == 2000


def test_alerts_are_listed_without_contracts_lots_and_awards(spark, monkeypatch):
    from tenderlake.plans import ingest

    written, write = [], ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, label: written.append(label) or write(df, label))
    body = spark.createDataFrame([('{"arrival": 1, "entreprise": {"nom": "a"}, "publication": {"numero": "p"}, "marche": {"objet": "o"}, "lots": [{"numero_lot": "1"}], "resultat": {}, "alerte": {"type_alerte": "fin"}}',)], "body string")
    saved = save_payloads({n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()}, parse_payloads(body), F.lit("2024-05-01 00:00:00"))
    assert [(r.entreprise.nom, r.publication.numero) for r in list_resource(saved, "alertes").collect()] == [("a", "p")]
    assert not {"marche", "lot", "resultat"} & set(written)
    assert [r.marche.objet for r in list_resource(saved, "resultats").collect()] == ["o"] and saved["lot"].count() == 1
    assert written.count("marche") == 1
