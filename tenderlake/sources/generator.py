"""Synthetic companies, seeded: the same rows for one seed on any cluster."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.defaults import draw_between, draw_some


# The form of generated numbers.
ID_FORM, PHONE_FORM, RCCM_FORM = "IDBURK%04d", "+226 %d", "RC%d"


def companies(spark: SparkSession, n: int, seed: int, today: datetime.date, domains: list[str], sectors: list[str], names: list[str], first_number: int = 1000) -> DataFrame:
    """``n`` rows in the form of a company, with its lists ``domaines`` (one to three) and ``secteurs`` (one or two).

    ``names`` are used in turn. Identification numbers count up from ``first_number``; registration numbers end in the row's number, so none occurs twice.
    """
    rows = spark.range(n).withColumnRenamed("id", "i")
    between = lambda low, high, part: draw_between(low, high, seed, F.lit(part), "i")
    some = lambda values, count, part: draw_some(F.array(*map(F.lit, values)), F.least(count, F.lit(len(values))), seed, F.lit(part), "i")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("i") % len(names) + 1).cast("int"))
    interests = some(domains, between(1, 3, "domain count"), "domains")
    return rows.select(
        (F.col("i") + 1).alias("id"),
        name.alias("nom"),
        F.format_string(ID_FORM, F.col("i") + first_number).alias("numero_identification"),
        F.format_string("%04d%010d", between(1000, 9999, "siret"), F.col("i")).alias("siret"),
        F.format_string("%d Rue de Ouaga", between(1, 100, "address")).alias("adresse"),
        F.format_string(PHONE_FORM, between(60_000_000, 79_999_999, "phone")).alias("telephone"),
        F.concat(F.lit("contact"), F.col("i").cast("string"), F.lit("@"), F.replace(F.lower(name), F.lit(" "), F.lit("")), F.lit(".bf")).alias("email"),
        F.date_sub(F.lit(today), between(365, 3650, "founded").cast("int")).alias("date_creation"),
        F.concat(F.lit("Entreprise spécialisée dans "), F.lower(interests[0]), F.lit(".")).alias("description"),
        F.format_string("Nom%d", F.col("i") + 1).alias("repnom"),
        F.format_string("Prénom%d", F.col("i") + 1).alias("repprenom"),
        F.format_string(RCCM_FORM, between(100_000, 999_999, "rccm")).alias("rccm"),
        interests.alias("domaines"),
        some(sectors, between(1, 2, "sector count"), "sectors").alias("secteurs"),
    )
