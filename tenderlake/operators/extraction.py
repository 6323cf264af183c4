"""Awards and tenders from the text of a section, as rows and as payloads for the mapper.

A notice begins with its kind and number, which may be followed by its date and its object. Statements behind it tell for each lot who gets it, for how much and how long, that nobody does, or, for an open
tender, what it is estimated at and until when offers come in. Statements are read by a chart parser (:mod:`tenderlake.functions.chart`) inside a table function, so the result is
rows that SQL can join: ``SELECT s.doc_id, n.* FROM sections s, LATERAL extract_notices(s.text) n`` after :func:`register`.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.chart import Edge, Rule, parse, reading, tokens
from tenderlake.operators.numbering import number_rows
from tenderlake.sources.shipping import ship_package

NOTICE = "notice int, kind string, reference string, date date, object string, lot int, status string, firm string, amount decimal(15,2), tax string, days int, deadline date"
MONTHS = {m: i for i, m in enumerate("janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), 1)}
#: Phrases and what they announce; of two that begin alike the longer is tried first.
PHRASES = {
    "appel d'offres": ("Kind", "tender"), "demande de prix": ("Kind", "tender"), "avis d'appel d'offres": ("Kind", "tender"), "résultats de l'appel d'offres": ("Kind", "award"),
    "résultats de la demande de prix": ("Kind", "award"), "lot": ("Lot", ""), "attribué à": ("Won", ""), "attributaire": ("Won", ""), "attributaire provisoire": ("Won", ""), "infructueux": ("Failed", "failed"),
    "montant": ("Price", ""), "montant de": ("Price", ""), "budget prévisionnel": ("Price", ""), "montant prévisionnel": ("Price", ""), "délai d'exécution": ("Delay", ""), "date limite": ("Limit", ""), "fcfa": ("Unit", ""), "francs cfa": ("Unit", ""),
    "f cfa": ("Unit", ""), "ttc": ("Tax", "TTC"), "ht": ("Tax", "HT"), "htva": ("Tax", "HT"), "jours": ("Days", "1"), "jour": ("Days", "1"), "mois": ("Days", "30"), "du": ("From", ""),
}
FORMS = {"SARL", "SA", "SAS", "SURL", "GIE", "ETS", "SNC", "SCI"}
_PHRASES = sorted(((tuple(t.lower() for t, _, _ in tokens(p)), k) for p, k in PHRASES.items()), key=lambda x: -len(x[0]))


def _date(day: int, month: int, year: int) -> dict | None:
    try:
        return {"date": datetime.date(year, month, day)}
    except ValueError:
        return None


def _only(a: dict, b: dict) -> dict | None:
    """Both together, if they don't say the same thing twice."""
    return None if a.keys() & b.keys() else {**a, **b}


RULES = (
    Rule("Amount", "Number", "Unit", lambda a, b: {"amount": a["n"]}),
    Rule("Amount", "Amount", "Tax", lambda a, b: None if "tax" in a else {**a, "tax": b["v"]}),
    Rule("Cost", "Price", "Amount", lambda a, b: b, gap=3),
    Rule("Length", "Number", "Days", lambda a, b: {"days": int(a["n"]) * int(b["v"])} if a["n"] < 100_000 else None),
    Rule("Time", "Delay", "Length", lambda a, b: b, gap=2),
    Rule("DayMonth", "Number", "Month", lambda a, b: {"d": a["n"], "m": b["v"]} if a["n"] < 32 else None),
    Rule("Date", "DayMonth", "Number", lambda a, b: _date(a["d"], a["m"], b["n"]) if b["n"] < 10_000 else None),
    Rule("Dated", "From", "Date", lambda a, b: b),
    Rule("Deadline", "Limit", "Date", lambda a, b: {"deadline": b["date"]}, gap=6),
    Rule("LotNo", "Lot", "Number", lambda a, b: {"lot": b["n"]} if b["n"] < 1000 else None, gap=2),
    Rule("Winner", "Won", "Name", lambda a, b: {"firm": b["v"], "status": "awarded"}, gap=2),
    Rule("Fail", "Failed", "End", lambda a, b: {"status": "failed"}),
    *(Rule("Item", "LotNo", x, _only, gap=4) for x in ("Winner", "Fail", "Cost", "Time", "Deadline")),
    *(Rule("Item", "Item", x, _only, gap=6) for x in ("Winner", "Cost", "Time", "Deadline")),
    *(Rule("Item", "Winner", x, _only, gap=6) for x in ("Cost", "Time")),
    Rule("Head", "Kind", "Reference", lambda a, b: {"kind": a["v"], "reference": b["v"]}, gap=3),
    Rule("Head", "Head", "Dated", _only, gap=2),
)
#: What a statement may say, in this order where it could be either.
GOALS = ("Head", "Item", "Winner", "Fail", "Cost", "Time", "Deadline")


def lexical(text: str) -> tuple[list[Edge], int]:
    """The edges of single words and phrases of a statement, and its number of words."""
    found = tokens(text)
    words = [w for w, _, _ in found]
    low = [w.lower().replace("’", "'") for w in words]
    edges = [Edge("End", i, i, 0, {}) for i in range(len(words) + 1)]
    for i, w in enumerate(words):
        for phrase, (kind, value) in _PHRASES:
            if low[i : i + len(phrase)] == list(phrase):
                edges.append(Edge(kind, i, i + len(phrase), len(phrase), {"v": value}))
        if low[i] in MONTHS:
            edges.append(Edge("Month", i, i + 1, 1, {"v": MONTHS[low[i]]}))
        if w.isdecimal() and len(w) <= 15:
            # A number with every group of three digits that may belong to it.
            n, end = w, i + 1
            edges.append(Edge("Number", i, end, 1, {"n": int(n)}))
            while end < len(words) and len(words[end]) == 3 and words[end].isdecimal() and len(w) <= 3 and len(n) < 15 and found[end][1] == found[end - 1][2] + 1:
                n += words[end]
                end += 1
                edges.append(Edge("Number", i, end, end - i, {"n": int(n)}))
            if m := _DAY.match(text, found[i][1]):
                value = _date(int(m[1]), int(m[2]), int(m[3]))
                if value:
                    edges.append(Edge("Date", i, i + 5, 5, value))
        if m := _REFERENCE.match(text, found[i][1]):
            end = next((k for k in range(i, len(found)) if found[k][2] >= m.end()), len(found) - 1) + 1
            edges.append(Edge("Reference", i, end, end - i, {"v": m[0].rstrip("./-")}))
        if w[0].isupper() and not (i and words[i - 1][0].isupper() and words[i - 1] not in FORMS):
            # A firm's name: words that begin with a capital, up to a legal form if there is one.
            end = i
            while end < len(words) and (words[end][0].isupper() or words[end] == "&") and low[end] not in ("lot", "montant"):
                end += 1
                if words[end - 1] in FORMS and end > i + 1:
                    break
            if end > i:
                edges.append(Edge("Name", i, end, end - i, {"v": text[found[i][1] : found[end - 1][2]]}))
    return edges, len(words)


_DAY = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)")
_REFERENCE = re.compile(r"(?=[\w./-]{0,60}\d)[0-9A-Z][\w./-]*")
_OBJECT = re.compile(r"\b(?:pour|relatifs?\s+(?:à|au|aux)|portant(?:\s+sur)?)\s+(.+)", re.S | re.I)
#: Where a statement ends: a line, or a full stop before a blank and a capital.
_STATEMENT = re.compile(r"\n+|(?<=[.;])\s+(?=[A-ZÉÈÀ])")


def notices(text: str | None) -> Iterator[tuple]:
    """The rows of a section's notices: one for each lot that a statement tells of, one for a notice of which no statement does. What precedes the first notice belongs to none."""
    number, head, items = 0, None, []

    def rows() -> Iterator[tuple]:
        if head is not None:
            for x in items or [{}]:
                status = x.get("status") or ("open" if head["kind"] == "tender" else None)
                yield (number, head["kind"], head["reference"], head.get("date"), head.get("object"), x.get("lot"), status, x.get("firm"), x.get("amount"), x.get("tax"), x.get("days"), x.get("deadline"))

    for statement in _STATEMENT.split(text or ""):
        edges, n = lexical(statement)
        for e in reading(parse(edges, RULES), GOALS, n):
            if e.kind == "Head":
                yield from rows()
                about = _OBJECT.search(statement[tokens(statement)[e.end - 1][2] :])
                number, head, items = number + 1, dict(e.value), []
                if about:
                    head["object"] = about[1].strip().rstrip(".;").strip()
            elif head is None:
                continue
            elif e.kind == "Item" or not items or not (items[-1].keys() & e.value.keys()) == set():
                items.append(dict(e.value))
            else:
                # What stands alone goes on about the lot before.
                items[-1] |= e.value
    yield from rows()


class ExtractNotices:
    def eval(self, text: str) -> Iterator[tuple]:
        for row in notices(text):
            amount = row[8]
            yield (*row[:8], None if amount is None or amount >= 10**13 else _decimal(amount), *row[9:])


def _decimal(n: int) -> Decimal:
    return Decimal(n).quantize(Decimal("0.01"))


def register(spark: SparkSession) -> None:
    """Make ``extract_notices(text)`` known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("extract_notices", F.udtf(ExtractNotices, returnType=NOTICE))


def extract(sections: DataFrame, text: str = "text") -> DataFrame:
    """The rows of all notices, behind the other columns of ``sections``. A section without notices, or with a null text, has none. Amounts of 14 digits or more are null, as no column holds them."""
    spark = sections.sparkSession
    register(spark)
    keep = [c for c in sections.columns if c != text]
    quoted = ", ".join(f"s.`{c}`" for c in keep)
    return spark.sql(f"SELECT {quoted}{', ' if keep else ''}n.* FROM {{s}} s, LATERAL extract_notices(s.`{text}`) n", s=sections)


def to_payloads(found: DataFrame, order: list[str]) -> DataFrame:
    """Payloads as the mapper takes them, one for each lot row of :func:`extract`, numbered as ``arrival`` by ``order`` (columns that tell the sections apart), notice and lot.

    Rows that nobody was awarded have no company and no result; an award's lot carries its amount."""
    numbered = number_rows(found, "arrival", [*order, "notice", F.col("lot").asc_nulls_first(), "status", "firm", "amount", "tax", "days", "deadline"])
    won = F.col("status") == "awarded"
    lot = F.when(F.col("lot").isNotNull(), F.array(F.struct(F.col("lot").alias("numero_lot"), F.col("object").alias("description"), F.col("amount").alias("montant"))))
    return numbered.select(
        "arrival",
        F.when(won, F.struct(F.col("firm").alias("nom"))).alias("entreprise"),
        F.struct(F.col("reference").alias("numero"), F.date_format("date", "yyyy-MM-dd").alias("date_publication"), F.coalesce("object", "reference").alias("titre")).alias("publication"),
        F.struct(F.coalesce("object", "reference").alias("objet")).alias("marche"),
        lot.alias("lots"),
        F.when(won, F.struct(F.col("amount").alias("montant_attribue"), F.when(F.col("days").isNotNull(), F.concat(F.col("days").cast("string"), F.lit(" jours"))).alias("delai_execution"))).alias("resultat"),
    )
