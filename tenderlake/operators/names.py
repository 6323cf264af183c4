"""Names that are known under a slightly different spelling: pairs within some edits, by an index of what is left when characters are deleted.

If two names are at most ``edits`` insertions, deletions or replacements apart, both can be brought to one string by deleting at most ``edits`` characters from each; and already from the first ``prefix``
characters of each, by taking what that string has there. So every name is filed under all such remainders of its beginning, equal remainders meet in a join, and what meets is verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Lower case, one blank between words, none around."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def _remainders(signs: str, edits: int, prefix: int) -> Column:
    """The distinct strings that are left of the first ``prefix`` characters when up to ``edits`` are deleted. Deletions beyond a short name's end delete nothing."""
    every = [gone for n in range(edits + 1) for gone in combinations(range(prefix), n)]
    kept = [[(0, prefix)] if not gone else [(a, b) for a, b in zip((0, *(g + 1 for g in gone)), (*gone, prefix), strict=True) if b > a] for gone in every]
    piece = lambda a, b: F.array_join(F.slice(signs, a + 1, b - a), "")
    return F.array_distinct(F.array(*(F.concat(*(piece(a, b) for a, b in parts)) if parts else F.lit("") for parts in kept)))


def near_names(names: DataFrame, known: DataFrame, name: str = "nom", known_name: str = "nom", known_id: str = "id", edits: int = 2, prefix: int = 10) -> DataFrame:
    """``name, known_id, known_name, distance``: for each distinct name all known ones within ``edits`` edits of it, both as :func:`normal_name` has them.

    Names are reduced to distinct ones before they are filed, on either side; ids of one known spelling are joined at last. A remainder is joined together with the length of the name, which may differ by ``edits``
    only, so names that begin alike are parted by length, and Spark's skew join splits a remainder that very many share. Null names match nothing; an empty name is near to those of up to ``edits`` characters.
    """
    asked = names.select(normal_name(F.col(name)).alias("_a")).where("_a IS NOT NULL").distinct()
    held = known.select(normal_name(F.col(known_name)).alias("_b")).where("_b IS NOT NULL").distinct()

    def filed(df: DataFrame, c: str, lengths: Column) -> DataFrame:
        signs = df.select(c, F.split(c, "").alias("_signs"))
        return signs.select(c, F.explode(_remainders("_signs", edits, prefix)).alias("_left")).withColumn("_size", F.explode(lengths))

    size = F.length("_a")
    left = filed(asked, "_a", F.sequence(F.greatest(size - edits, F.lit(0)), size + edits))
    right = filed(held, "_b", F.array(F.length("_b")))
    pairs = left.join(right, ["_left", "_size"]).select("_a", "_b").distinct()
    near = pairs.withColumn("distance", F.levenshtein("_a", "_b", edits)).where("distance >= 0")
    rows = known.select(F.col(known_id).alias("known_id"), F.col(known_name).alias("known_name"), normal_name(F.col(known_name)).alias("_b"))
    return near.join(rows, "_b").select(F.col("_a").alias("name"), "known_id", "known_name", "distance")


def resolve_names(names: DataFrame, known: DataFrame, name: str = "nom", known_name: str = "nom", known_id: str = "id", edits: int = 2, prefix: int = 10) -> DataFrame:
    """``names`` with ``known_id``: of the nearest known name, of equally near ones the smallest id; null if none is within ``edits`` edits."""
    best = near_names(names, known, name, known_name, known_id, edits, prefix).groupBy("name").agg(F.min(F.struct("distance", "known_id")).alias("_best"))
    side = best.select(F.col("name").alias("_name"), F.col("_best.known_id").alias("known_id"))
    return names.join(side, normal_name(F.col(name)) == F.col("_name"), "left").drop("_name")
