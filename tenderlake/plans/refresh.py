"""Nested records kept up to date: changed keys travel over the references to the records that show them, and only those are gathered again."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.plans.resources import RESOURCES, Tables
from tenderlake.schemas import TABLES
from tenderlake.sources.tables import materialize

#: What a table's record shows: rows that it refers to (column, table), and rows that refer to it (table, column).
SHOWS: dict[str, tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]] = {
    "publication_domaine": ((("domaine_id", "domaine"),), ()),
    "publication": ((), (("publication_domaine", "publication_id"),)),
    "marche": ((("publication_id", "publication"), ("type_procedure_id", "type_procedure")), (("lot", "marche_id"),)),
    "appel_offre": ((("marche_ptr_id", "marche"),), ()),
    "entreprise_domaine": ((("domaine_id", "domaine"),), ()),
    "entreprise_secteur": ((("secteur_id", "secteur_activite"),), ()),
    "entreprise": ((), (("entreprise_domaine", "entreprise_id"), ("entreprise_secteur", "entreprise_id"))),
    "resultat": ((("marche_id", "marche"), ("entreprise_attributaire_id", "entreprise")), ()),
    "alerte": ((("entreprise_id", "entreprise"), ("publication_id", "publication")), ()),
    "utilisateur": ((("entreprise_id", "entreprise"),), ()),
}


def affected(t: Tables, name: str, changed: Mapping[str, DataFrame]) -> DataFrame | None:
    """``key``, distinct: the records of a table that show a changed row, however deep; None if none can. ``changed``: for each table one column of keys."""
    to, by = SHOWS.get(name, ((), ()))
    found = [changed[name].select(F.col(changed[name].columns[0]).cast("long").alias("key"))] if name in changed else []
    within = lambda rows, column, keys, out: rows.join(keys.select(F.col("key").alias("_changed")), F.col(column) == F.col("_changed"), "left_semi").select(F.col(out).alias("key"))
    for column, target in to:
        if (keys := affected(t, target, changed)) is not None:
            found.append(within(t[name], column, keys, TABLES[name].key))
    for child, column in by:
        if (keys := affected(t, child, changed)) is not None:
            found.append(within(t[child], TABLES[child].key, keys, column))
    return reduce(DataFrame.unionByName, found).where("key IS NOT NULL").distinct() if found else None


def refresh(records: DataFrame, before: Tables, after: Tables, resource: str, changed: Mapping[str, DataFrame]) -> DataFrame:
    """The nested records of a resource after a change: those that show nothing changed as they are, the others gathered again from the tables.

    ``records`` has the resource's shown columns and ``record_key``, as :func:`build` gives them; ``changed`` has for each table the keys of rows that were added, changed or removed. Both states of the tables are asked, as a
    row that has moved belongs to two records. The keys are written once; they reach the tables by semi joins, so what is gathered grows with what has changed.
    """
    table = RESOURCES[resource].table
    sides = [keys for t in (before, after) if (keys := affected(t, table, changed)) is not None]
    if not sides:
        return records
    keys = materialize(reduce(DataFrame.unionByName, sides).distinct(), "changed-records")
    kept = records.join(keys, records["record_key"] == keys["key"], "left_anti")
    return kept.unionByName(build(after, resource, keys))


def build(t: Tables, resource: str, keys: DataFrame | None = None) -> DataFrame:
    """All nested records of a resource, or those of ``keys``, with ``record_key``."""
    r = RESOURCES[resource]
    rows = r.rows(t)
    if keys is not None:
        rows = rows.join(keys.select(F.col("key").alias("_wanted")), F.col(r.key) == F.col("_wanted"), "left_semi")
    return r.present(t, rows.withColumn("_sort_key", F.col(r.key))).withColumnRenamed("_sort_key", "record_key")
