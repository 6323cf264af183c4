"""The write service: for each table create, change and remove, each a set-based plan over a whole batch of requests.

A request is a row with a number ``arrival`` (distinct). The batch counts as if its requests had come one after the other in that order. A request that breaks
a rule is refused as a whole and reported; the others go on. Nothing is stored here: the new tables are returned, to be committed together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators import integrity, upsert
from tenderlake.schemas import TABLES, Table
from tenderlake.sources.shipping import ship_package
from tenderlake.sources.tables import discard, materialize

Tables = Mapping[str, DataFrame]
#: Table to its many-to-many relations: bridge to (its parent column, its target column, the request's array of ids).
Links = Mapping[str, Mapping[str, tuple[str, str, str]]]
LINKS: Links = {"entreprise": {"entreprise_domaine": ("entreprise_id", "domaine_id", "domaine_ids"), "entreprise_secteur": ("entreprise_id", "secteur_id", "secteur_ids")}}


@dataclass(frozen=True)
class Written:
    """``refused``: ``row_key`` (the request's arrival as text), ``rule, field, value``; a request that breaks several rules has several rows."""

    tables: dict[str, DataFrame]
    refused: DataFrame


def create(t: Tables, name: str, requests: DataFrame, metadata: Mapping[str, Table] = TABLES, links: Links = LINKS) -> Written:
    """Insert the requests that break no rule, with ids behind the largest one in order of arrival, and a bridge row for each id in their arrays (repeats too).

    Columns that the requests lack count as null. A table whose key refers to another one (an award's contract) takes its key from the request, once for each.
    """
    table = metadata[name]
    allotted = table.key not in {r.column for r in table.references}
    fields = [c.name for c in table.columns if not (allotted and c.name == table.key)]
    ids = [x for _, _, x in links.get(name, {}).values() if x in requests.columns]
    asked = materialize(requests.select("arrival", *(F.col(f) if f in requests.columns else F.lit(None).cast("string").alias(f) for f in fields), *ids), f"create-{name}")
    broken = materialize(_violations(table, asked, t, metadata, links.get(name, {})), f"refused-{name}")
    sound = _without(asked, broken)
    unique = [c.name for c in table.columns if c.name in fields and (c.unique or c.name == table.key)]
    repeated = take_in_turn(_claims(sound, unique, "arrival"), _claims(t[name], unique))
    accepted = _without(sound, repeated)
    out = dict(t)
    if allotted:
        used = {bridge: link for bridge, link in links.get(name, {}).items() if link[2] in ids}
        out[name], bridges = upsert.create_with_links(t[name], {b: t[b] for b in used}, accepted, ["arrival"], used)
        out |= bridges
    else:
        out[name] = t[name].unionByName(accepted.select(*(F.col(c).cast(kind) for c, kind in t[name].dtypes)))
    return Written(out, broken.unionByName(repeated))


def change(t: Tables, name: str, requests: DataFrame, given: str | None = "given", metadata: Mapping[str, Table] = TABLES, links: Links = LINKS) -> Written:
    """Change rows by their key. ``given`` names an array of the columns that a request sets, null values among them; None: it sets all columns that the requests have.

    Of several requests for one key the first counts, the others are refused. Rules are checked for what is set. A value that must be unique is taken if any other row
    held it before the batch, or an accepted request before sets it. An array of ids that is null leaves the relation, another replaces it.
    """
    table, key = metadata[name], metadata[name].key
    asked = materialize(requests, f"change-{name}")
    report = lambda df, rule: df.select(F.col("arrival").cast("string").alias("row_key"), F.lit(rule).alias("rule"), F.lit(key).alias("field"), F.col(key).cast("string").alias("value"))
    first = asked.groupBy(F.col(key).alias("_key")).agg(F.min("arrival").alias("_first"))
    known = asked.join(t[name].select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    single = known.join(first, F.col("arrival") == F.col("_first"), "left_semi")
    later = known.join(first, F.col("arrival") == F.col("_first"), "left_anti")
    unknown = asked.join(t[name].select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")

    fields = [c.name for c in table.columns if c.name in requests.columns and c.name != key]
    named = lambda df, field: df.where(F.array_contains(given, F.col(field))) if given else df
    sets = single.select(F.col("arrival").cast("string").alias("row_key"), *([given] if given else []))
    # Rules see what a request sets; a link's ids are always seen, as null leaves them.
    ids = [x for _, _, x in links.get(name, {}).values() if x in requests.columns]
    found = _violations(table, single.select("arrival", *fields, *ids), t, metadata, links.get(name, {})).join(sets, "row_key")
    of_links = F.col("field").isin(ids) if ids else F.lit(False)
    seen = found.where(of_links).unionByName(named(found.where(~of_links), "field")).select("row_key", "rule", "field", "value")
    broken = materialize(reduce(DataFrame.unionByName, [report(unknown, "unknown"), report(later, "one change for a key"), seen]), f"refused-{name}")

    sound = _without(single, broken)
    unique = [c.name for c in table.columns if c.unique and c.name in fields]
    claims = named(_claims(sound, unique, "arrival", key, *([given] if given else [])), "field").select("arrival", key, "field", "value")
    own = _claims(t[name], unique, key)
    # What a row holds already isn't claimed anew.
    claims = claims.join(own, [key, "field", "value"], "left_anti").select("arrival", "field", "value")
    repeated = take_in_turn(claims, own.select("field", "value"))
    accepted = _without(sound, repeated)
    out = dict(t)
    out[name] = upsert.patch(t[name], accepted.select(key, *fields, *([given] if given else [])), key, given)
    for bridge, (left, right, listed) in links.get(name, {}).items():
        if listed in ids:
            out[bridge] = upsert.replace_links(t[bridge], accepted.select(F.col(key).alias(left), listed), left, right, listed)
    return Written(out, broken.unionByName(repeated))


def remove(t: Tables, name: str, requests: DataFrame, metadata: Mapping[str, Table] = TABLES) -> Written:
    """Delete the rows of the requests' keys, with all that a deletion entails. A key that is unknown, or that a request before has deleted, is refused."""
    key = metadata[name].key
    here = requests.join(t[name].select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    first = here.groupBy(F.col(key).alias("_key")).agg(F.min("arrival").alias("_first"))
    failed = requests.join(first, F.col("arrival") == F.col("_first"), "left_anti")
    refused = failed.select(F.col("arrival").cast("string").alias("row_key"), F.lit("unknown").alias("rule"), F.lit(key).alias("field"), F.col(key).cast("string").alias("value"))
    return Written(integrity.delete(t, name, here.select(key), metadata), refused)


def take_in_turn(claims: DataFrame, held: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The claims (``arrival, field, value``) by which requests are refused, if they are tried in order of arrival and each accepted one takes all of its values.

    ``held`` (``field, value``) is taken from the start. In each round a request that comes first for all of its values is accepted, and the others that want one of these are
    refused, by the values that they lose in that round. With one unique field a round settles all; with several, as many rounds as requests block each other in a chain. Once at most ``few`` claims are left, one task
    settles them in one pass, with the same result. Values are reduced to their first request
    before they are joined, so a value in very many requests is joined with one row, and Spark's skew join may split its requests.
    """
    claims = materialize(claims, "claims")
    blocked = materialize(claims.join(held.select("field", "value").distinct(), ["field", "value"], "left_semi").select("arrival", "field", "value"), "claims-held")
    refused = [blocked]
    open_ = materialize(claims.join(blocked.select("arrival").distinct(), "arrival", "left_anti").select("arrival", "field", "value"), "claims-open")
    discard(claims)
    while open_.count() > few:
        first = open_.groupBy("field", "value").agg(F.min("arrival").alias("first"))
        standing = materialize(open_.join(first, ["field", "value"]).select("arrival", "field", "value", "first"), "claims-standing")
        winners = materialize(standing.groupBy("arrival").agg(F.bool_and(F.col("arrival") == F.col("first")).alias("_all")).where("_all").select("arrival"), "claims-won")
        lost = standing.join(winners.select(F.col("arrival").alias("first")), "first", "left_semi").where("arrival != first")
        blocked = materialize(lost.select("arrival", "field", "value"), "claims-lost")
        refused.append(blocked)
        settled = winners.unionByName(blocked.select("arrival").distinct())
        before, open_ = open_, materialize(standing.join(settled, "arrival", "left_anti").select("arrival", "field", "value"), "claims-open")
        discard(before, standing, winners)
    refused.append(_settled(open_))
    report = reduce(DataFrame.unionByName, refused)
    return report.select(F.col("arrival").cast("string").alias("row_key"), F.lit("unique").alias("rule"), "field", "value")


def _settled(claims: DataFrame) -> DataFrame:
    """The claims that lose, found in one pass in order of arrival. Each request knows the round in which it would have been settled: an accepted one the round behind all earlier requests for its
    values, a refused one the first round in which one of its values is taken."""
    schema = claims.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: dict[tuple[str, str], int] = {}  # value to the round in which it was
        asked: dict[tuple[str, str], int] = {}  # value to the last round of those that asked for it
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        lost: list[tuple] = []
        for arrival, own in groupby(rows, key=lambda r: r.arrival):
            values = [(r.field, r.value) for r in own]
            rounds = [taken[v] for v in values if v in taken]
            round_ = min(rounds) if rounds else 1 + max(asked.get(v, 0) for v in values)
            lost += [(arrival, *v) for v in values if rounds and taken.get(v) == round_]
            for v in values:
                asked[v] = max(asked.get(v, 0), round_)
                if not rounds:
                    taken[v] = round_
            if len(lost) >= 10_000:
                yield pd.DataFrame(lost, columns=["arrival", "field", "value"])
                lost = []
        yield pd.DataFrame(lost, columns=["arrival", "field", "value"]).astype({"arrival": "int64"})

    ship_package(claims.sparkSession)
    return claims.repartition(1).sortWithinPartitions("arrival").mapInPandas(run, schema)


def _claims(rows: DataFrame, fields: Sequence[str], *keep: str) -> DataFrame:
    """A row for each value in ``fields`` that isn't null."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    listed = F.array(*pairs) if pairs else F.lit(None).cast("array<struct<field: string, value: string>>")
    return rows.select(*keep, F.explode(listed).alias("_c")).select(*keep, "_c.*").where("value IS NOT NULL")


def _violations(table: Table, asked: DataFrame, t: Tables, metadata: Mapping[str, Table], links: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """What requests break by themselves: rules of their values, references and listed ids that lead nowhere (a listed null among them)."""
    reports = [integrity.validate(table.name, asked, t, metadata, "arrival", unique=False)]
    for bridge, (_, right, ids) in links.items():
        if ids in asked.columns:
            target = next(r.target for r in metadata[bridge].references if r.column == right)
            side = t[target].select(F.col(metadata[target].key).alias("_target"))
            lost = asked.select("arrival", F.explode(ids).alias("_id")).join(side, F.col("_id") == F.col("_target"), "left_anti")
            reports.append(lost.select(F.col("arrival").cast("string").alias("row_key"), F.lit("reference").alias("rule"), F.lit(ids).alias("field"), F.col("_id").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, reports)


def _without(requests: DataFrame, report: DataFrame) -> DataFrame:
    gone = report.select(F.col("row_key").alias("_row")).distinct()
    return requests.join(gone, F.col("arrival").cast("string") == F.col("_row"), "left_anti")
