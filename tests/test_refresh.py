"""Records that are kept up to date equal those that are built anew, after random changes."""

import random

import pytest
from pyspark.sql import functions as F

from tenderlake.plans.refresh import affected, build, refresh
from tenderlake.schemas import TABLES


def random_tables(dice):
    """Rows of each table by key, with references into small ranges, some of them nowhere."""
    sizes = {"domaine": 5, "secteur_activite": 4, "type_procedure": 3, "publication": 12, "entreprise": 9, "marche": 12, "lot": 25, "publication_domaine": 20, "entreprise_domaine": 12, "entreprise_secteur": 12, "resultat": 9, "alerte": 15, "appel_offre": 6, "utilisateur": 7}
    return {name: {i: random_row(dice, name, i) for i in range(sizes[name])} for name in sizes}


def random_row(dice, name, key):
    targets = {r.column: r.target for r in TABLES[name].references}
    values = {"long": lambda: dice.randrange(10), "int": lambda: dice.randrange(5), "str": lambda: f"t{dice.randrange(1000)}", "bool": lambda: True}
    return tuple(key if c.name == TABLES[name].key else dice.choice([None, dice.randrange(9)]) if c.name in targets and c.nullable else dice.randrange(9) if c.name in targets else values.get(c.kind, lambda: None)() for c in TABLES[name].columns)


def as_tables(spark, rows):
    free = lambda schema: "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema) + ">"
    return {name: spark.createDataFrame(list(rows[name].values()), free(TABLES[name].schema)) for name in rows}


def shown(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())


@pytest.mark.parametrize("seed", range(3))
def test_refreshed_records_equal_rebuilt_ones(spark, seed):
    dice = random.Random(seed)
    rows = random_tables(dice)
    before = as_tables(spark, rows)
    changed = {}
    for name in dice.sample(sorted(rows), 4):
        keys = dice.sample(sorted(rows[name]), 2) + [100 + seed]
        rows[name] = dict(rows[name])
        for k, what in zip(keys, ("change", dice.choice(["change", "remove"]), "add"), strict=True):
            rows[name].pop(k, None) if what == "remove" else rows[name].__setitem__(k, random_row(dice, name, k))
        changed[name] = spark.createDataFrame([(k,) for k in keys], "k long")
    after = as_tables(spark, rows)
    for resource in ("marches", "resultats", "alertes", "entreprises"):
        assert shown(refresh(build(before, resource), before, after, resource, changed)) == shown(build(after, resource)), resource


def test_only_what_shows_a_change_is_gathered(spark):
    t = as_tables(spark, random_tables(random.Random(9)))
    one = {"lot": spark.createDataFrame([(3,)], "k long")}
    marche = t["lot"].where("id = 3").first().marche_id
    assert [r.key for r in affected(t, "marche", one).collect()] == [marche] and affected(t, "alerte", one) is None
    assert {r.key for r in affected(t, "resultat", one).collect()} == {r.marche_id for r in t["resultat"].where(F.col("marche_id") == marche).collect()}
    records = build(t, "alertes")
    assert refresh(records, t, t, "alertes", one) is records
