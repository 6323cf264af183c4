"""Notices made here come back as rows, and reach the tables."""

import datetime
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tenderlake.functions.chart import Edge, Rule, parse, reading
from tenderlake.operators import extraction as E

MONTHS = list(E.MONTHS)


def spaced(n):
    return f"{n:,}".replace(",", " ")


def notice(dice):
    """A text and the rows that it says."""
    award = dice.random() < 0.6
    day = datetime.date(2020, 1, 1) + datetime.timedelta(days=dice.randrange(1500))
    reference = f"{day.year}-{dice.randrange(100):03d}/MS/SG"
    about = dice.choice(["la construction d'une école", "l'acquisition de 3 véhicules", "travaux de bitumage de la RN 4"])
    kind = dice.choice(["Résultats de l'appel d'offres", "Résultats de la demande de prix"] if award else ["Avis d'appel d'offres", "Demande de prix"])
    written = f"{day.day} {MONTHS[day.month - 1]} {day.year}" if dice.random() < 0.5 else f"{day:%d/%m/%Y}"
    lines, rows = [f"{kind} n° {reference} du {written} pour {about}."], []
    for lot in range(1, dice.randrange(1, 4) + 1):
        amount, days = dice.choice([dice.randrange(1, 999), dice.randrange(10**6, 10**11)]), dice.randrange(10, 400)
        head = ("award" if award else "tender", reference, day, about, lot)
        if not award:
            end = day + datetime.timedelta(days=30)
            lines.append(f"Lot {lot} : montant prévisionnel de {spaced(amount)} FCFA HT, date limite de dépôt le {end.day} {MONTHS[end.month - 1]} {end.year}.")
            rows.append((*head, "open", None, Decimal(amount), "HT", None, end))
        elif dice.random() < 0.25:
            lines.append(f"Lot {lot} : infructueux.")
            rows.append((*head, "failed", None, None, None, None, None))
        else:
            firm = dice.choice(["SOMBA Services SARL", "Ets Kaboré & Frères SA", "GLOBAL BTP", "Faso Routes SAS"])
            verb = dice.choice(["attribué à", "attributaire :"])
            tail = f" avec un délai d'exécution de {days} jours" if dice.random() < 0.7 else ""
            lines.append(f"Lot n° {lot} : {verb} {firm} pour un montant de {spaced(amount)} FCFA TTC{tail}.")
            rows.append((*head, "awarded", firm, Decimal(amount), "TTC", days if tail else None, None))
    return "\n".join(lines) if dice.random() < 0.5 else " ".join(lines), rows


def test_generated_notices_come_back(spark):
    dice = random.Random(9)
    sections, want = [], []
    for i in range(60):
        parts = [notice(dice) for _ in range(dice.randrange(4))]
        sections.append((i, "Page de garde, lot 9.\n" * (i % 2) + "\n".join(t for t, _ in parts), "x"))
        want += [(i, k, *r) for k, (_, rows) in enumerate(parts, 1) for r in rows]
    df = spark.createDataFrame([*sections, (900, None, "y"), (901, "", "y")], "doc_id long, text string, other string")
    got = E.extract(df).drop("other")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((*r[:9], None if r[9] is None else r[9].quantize(Decimal("0.01")), *r[10:])) for r in want)
    df.createOrReplaceTempView("sections_of_test")
    assert spark.sql("SELECT count(DISTINCT n.reference) AS n FROM sections_of_test s, LATERAL extract_notices(s.text) n").first().n == len({r[3] for r in want})


def said(text):
    return [r[5:10] for r in E.notices("Résultats de l'appel d'offres n° 1/A pour x.\n" + text)]


def test_ambiguous_statements_are_read_by_the_rule():
    """Most words are explained, then fewest parts."""
    assert said("Lot 2 500 000 FCFA attribué à Alpha SA") == [(2, "awarded", "Alpha SA", None, None)]
    assert said("Lot 2 montant 500 000 FCFA") == [(2, None, None, 500_000, None)]
    assert said("Lot 1 : attribué à Alpha SA. Montant de 5 FCFA. Lot 2 : infructueux") == [(1, "awarded", "Alpha SA", 5, None), (2, "failed", None, None, None)]
    assert said("attribué à Alpha SA pour un montant de 1 000 FCFA HT") == [(None, "awarded", "Alpha SA", 1000, "HT")]
    assert said("rien de tout cela le 31 février 2024") == [(None, None, None, None, None)]
    assert list(E.notices("Lot 1 : infructueux")) == list(E.notices(None)) == []


def test_readings_by_brute_force():
    """Of random edges the best row, against all rows."""
    from itertools import combinations

    dice = random.Random(3)
    for _ in range(200):
        edges = [Edge("g", a := dice.randrange(8), a + dice.randrange(1, 4), dice.randrange(1, 4), {}) for _ in range(dice.randrange(8))]
        edges = list({(e.start, e.end): e for e in edges}.values())
        got = reading(edges, ("g",), 12)
        rows = [r for n in range(len(edges) + 1) for r in combinations(sorted(edges, key=lambda e: e.start), n) if all(a.end <= b.start for a, b in zip(r, r[1:], strict=False))]
        best = max((sum(e.words for e in r), -len(r)) for r in rows)
        assert (sum(e.words for e in got), -len(got)) == best
    made = parse([Edge("a", 0, 1, 1, {}), Edge("a", 1, 2, 1, {}), Edge("a", 3, 4, 1, {})], [Rule("b", "a", "a"), Rule("b", "b", "a", gap=1)])
    assert {(e.kind, e.start, e.end) for e in made if e.kind == "b"} == {("b", 0, 2), ("b", 0, 4)}


def test_long_statements_take_linear_time():
    import time

    began = time.process_time()
    list(E.notices("Résultats de l'appel d'offres n° 1 pour x. " + "Lot 1 attribué à Alpha " * 3000))
    list(E.notices("1 " * 20_000 + "Alpha " * 20_000))
    assert time.process_time() - began < 30


def test_notices_reach_the_tables(spark):
    from tenderlake.plans.ingest import save_payloads
    from tenderlake.schemas import TABLES
    from tenderlake.sources.files import parse_payloads

    text = "Résultats de la demande de prix n° 2024-007/MS du 12 mars 2024 pour un pont.\nLot 1 : attribué à Alpha SARL pour un montant de 12 500 000 FCFA TTC avec un délai d'exécution de 90 jours.\nLot 2 : infructueux."
    found = E.extract(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    payloads = parse_payloads(E.to_payloads(found, ["doc_id"]).select(F.to_json(F.struct("*")).alias("body")))
    t = save_payloads({n: spark.createDataFrame([], x.schema) for n, x in TABLES.items()}, payloads, F.lit("2024-05-01 00:00:00"))
    assert [(r.numero, str(r.date_publication)) for r in t["publication"].collect()] == [("2024-007/MS", "2024-03-12")]
    assert [r.nom for r in t["entreprise"].collect()] == ["Alpha SARL"] and sorted(r.numero_lot for r in t["lot"].collect()) == [1, 2]
    assert [(r.montant_attribue, r.delai_execution) for r in t["resultat"].collect()] == [(Decimal("12500000.00"), "90 jours")]
    assert json.dumps([r.objet for r in t["marche"].collect()]) == '["un pont"]'
