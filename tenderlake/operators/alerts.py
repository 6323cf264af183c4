"""Tags by dictionary, and alerts for companies whose interests a publication meets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tenderlake.operators.term_index import TermIndex
from tenderlake.sources.shipping import ship_package
from tenderlake.sources.tables import materialize


def _grams(signs: str, sizes: Iterable[int]) -> Column:
    """The distinct runs of so many characters, overlapping ones too, of a column of single characters; the empty run is among them if asked for."""
    runs = lambda n: F.transform(F.col(signs), lambda _, i: F.concat(*(F.get(F.col(signs), i + j) for j in range(n))))
    # What begins too near the end to be whole is null.
    return F.array_distinct(F.concat(*(F.array(F.lit("")) if n == 0 else F.array_compact(runs(n)) for n in sizes)))


def find_tags(df: DataFrame, dictionary: DataFrame, key: str, text: str = "text", gram: int = 8, window: int = 1 << 20, most: int = 200_000, few: int = 200) -> DataFrame:
    """``key`` and ``tags``: the sorted tags of all dictionary rows (``term, tag``) whose term the text holds anywhere, whatever its case. One row for each key.

    The dictionary may have any size, and terms any characters. Each term is filed under a run of ``gram`` bytes (a shorter term under itself), the one that the fewest terms have
    (:class:`~tenderlake.operators.term_index.TermIndex`). Filed terms are broadcast, ``most`` at a time: a larger dictionary is cut by hash into shards, each with a probe of its own. The texts stay in
    their partitions, where all runs of ``window`` places at a time are looked up, and what is found is compared with the whole term; only keys and tags are shuffled.

    A dictionary of up to ``few`` rows takes a shorter way to the same rows: its terms are looked for one by one in the plan, and the texts are read once.

    A null text counts as empty; an empty term is in every text; rows of the dictionary with a null are ignored. Texts that repeat a key share its tags. Jobs run while the result is built.
    """
    terms = materialize(dictionary.select(F.lower("term").alias("term"), "tag").where("term IS NOT NULL AND tag IS NOT NULL").distinct(), "terms")
    low = df.select(F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_low"))
    head = terms.limit(few + 1).collect()
    if len(head) <= few:
        hits = F.array(F.lit(None).cast("string"), *(F.when(F.contains("_low", F.lit(r["term"])), F.lit(r["tag"])) for r in sorted(head)))
        found = low.select("_key", F.array_distinct(F.array_compact(hits)).alias("_hits"))
        return found.groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_hits")))).alias("tags"))

    spark = df.sparkSession
    ship_package(spark)
    # Batches of texts are bounded by bytes as well as rows.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    probed = low.select("_key", F.col("_low").cast("binary"))
    schema = StructType([probed.schema["_key"], StructField("_hits", ArrayType(StringType()))])
    shards = -(-terms.count() // most) or 1

    def probe(i: int) -> DataFrame:
        filed = terms.where(F.pmod(F.hash("term"), F.lit(shards)) == i).select(F.col("term").cast("binary"), "tag").toArrow()
        shared = spark.sparkContext.broadcast(TermIndex(filed["term"].to_pylist(), filed["tag"].to_pylist(), gram))
        return probed.mapInArrow(lambda batches: shared.value.tag_batches(batches, window), schema)

    found = reduce(DataFrame.unionByName, [probe(i) for i in range(shards)])
    return found.groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_hits")))).alias("tags"))


def tag_by_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``tags``, as :func:`find_tags` finds them, for each row by itself. The rows are numbered and written first, so that any table will do."""
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "to-tag")
    return numbered.join(find_tags(numbered, dictionary, "_row", text), "_row").drop("_row")


def tag_by_words(df: DataFrame, dictionary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``tags`` by whole words, not by parts of words as :func:`find_tags`: runs of words and terms of one or several words meet in an equi-join.

    Letters and digits make words, whatever stands between them. As long as the longest term's, every run of words is looked up, so no term is left out.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    terms = dictionary.select(F.array_join(words(F.col("term")), " ").alias("_run"), F.size(words(F.col("term"))).alias("_n"), "tag").where("_n > 0 AND tag IS NOT NULL").distinct()
    longest = terms.agg(F.max("_n")).first()[0] or 0
    # A run of n words for each place at which one fits.
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (n - 1), F.lit(1))), lambda i, n=n: F.array_join(F.slice(F.col("_words"), i, n), " ")) for n in range(1, longest + 1)]
    split = df.select(key, words(F.col(text)).alias("_words"))
    if runs:
        found = split.select(key, F.explode(F.array_distinct(F.concat(*runs))).alias("_run")).join(terms, "_run").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    else:
        found = split.where("false").select(key, F.array().cast("array<string>").alias("tags"))
    return df.select(key).join(found, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def match_alerts(publication_topics: DataFrame, company_topics: DataFrame, publication: str = "publication_id", company: str = "entreprise_id", topic: str = "domaine_id", wide: int = 1000) -> DataFrame:
    """Each (company, publication) that share a topic, once.

    Both sides bring all their topics to the join, and a pair is taken at the smallest topic that they share. So pairs, which are the result itself, go into no shuffle. Those of whatever has more than ``wide`` topics
    don't bring them and are told apart by a shuffle. AQE splits a topic that very many follow.
    """

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        own = df.where(F.col(topic).isNotNull()).groupBy(key).agg(F.collect_set(topic).alias("_all"))
        return own.select(key, F.when(F.size("_all") <= wide, F.col("_all")).alias(name), F.explode("_all").alias(topic))

    ours, theirs = side(publication_topics, publication, "_ours"), side(company_topics, company, "_theirs")
    narrow = ours.where("_ours IS NOT NULL").join(theirs.where("_theirs IS NOT NULL"), topic)
    first = (F.size("_ours") == 1) | (F.size("_theirs") == 1) | (F.col(topic) == F.array_min(F.array_intersect("_ours", "_theirs")))
    repeated = ours.join(theirs.where("_theirs IS NULL"), topic).select(company, publication).unionByName(ours.where("_ours IS NULL").join(theirs.where("_theirs IS NOT NULL"), topic).select(company, publication))
    return narrow.where(first).select(company, publication).unionByName(repeated.distinct())


def alert_rows(matches: DataFrame, kind: str, content: Column, channel: str, now: Column) -> DataFrame:
    """Alerts to append for the matches. The clock is an argument, so a plan run twice says the same."""
    return matches.select(
        "entreprise_id",
        "publication_id",
        F.lit(kind).alias("type_alerte"),
        now.cast("timestamp").alias("date_alerte"),
        content.alias("contenu_alerte"),
        F.lit(channel).alias("canal_alerte"),
    )


def date_facet(df: DataFrame, column: str, choice: str, today: Column) -> DataFrame:
    """The rows of a date facet: ``any, today, past_7_days, month, year, null, not_null``. Ranges, so they reach the scan."""
    c, t = F.col(column).cast("date"), today.cast("date")
    tests = {
        "any": F.lit(True),
        "today": c == t,
        "past_7_days": (c >= F.date_sub(t, 7)) & (c <= t),
        "month": (c >= F.trunc(t, "month")) & (c < F.add_months(F.trunc(t, "month"), 1)),
        "year": (c >= F.trunc(t, "year")) & (c < F.add_months(F.trunc(t, "year"), 12)),
        "null": c.isNull(),
        "not_null": c.isNotNull(),
    }
    return df.where(tests[choice])
