"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations alone.

Each row becomes a small key: a 64-bit digest of its normalised text, the SHA-256 that confirms it, its length, its id and a number of its own.
A partition's keys are a leaf run, so there are as many leaves as the input has partitions, and a group of copies, however large, is reduced to one entry of its
leaf before anything is shuffled. Runs are cut by bits of the digest (``shard``), so that no task ever holds a whole run.
In each round the runs whose numbers agree but for the lowest digit meet (a binomial exchange of ``fan`` runs): sorted by digest, they are
merged, and of each digest one entry survives with the best row so far and the number of rows behind it. An entry
that enters a merge already stands for all copies below it, so no merge reads more than ``fan`` entries for a digest.
Entries are one only if the SHA-256 agrees as well as the digest: that is the check at every level.
The last round holds one entry a text. The way back uses the same leaves: a leaf has one entry for each of
its texts, whose winner it takes from the root, and passes it to its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import free_name, text_of, without_ids
from tenderlake.sources.tables import load_table, materialize

#: Characters that don't count when texts are compared.
BLANK = r"[\x20\x09-\x0D]+"


def normalised(column: str):
    return F.regexp_replace(text_of(column), BLANK, "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Texts are equal when they are the same without blanks (space, tab to carriage return); null counts as empty. Of equal
    texts the row with the most code points stays, then the one with the smallest id; a null id comes last. Of rows that
    repeat an id and a text, exactly one is kept. ``group_size`` counts rows. Other columns aren't read, whatever their names.
    An empty table gives an empty result. Jobs run while the result is built.
    """
    keys = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.length(text_of(text_col)).cast("bigint").alias("n_chars"),
        normalised(text_col).alias("body"),
    ).select("doc_id", "n_chars", F.xxhash64("body").alias("digest"), F.unhex(F.sha2("body", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    # Written once: the way back reads the same rows and numbers, and a lost executor costs a read instead of a pass over all texts.
    rows = materialize(keys, "dedup-rows")
    # The high bits of a row's number are those of its partition.
    rows = rows.withColumn("node", F.shiftright("row", 33).cast("int"))
    leaves = 1 + (rows.agg(F.max("node")).first()[0] or 0)
    rows = rows.withColumn("shard", F.shiftrightunsigned("digest", 40) % leaves)

    # The complement turns the order of ids round; a null id is least, so it loses to any other.
    key = ["node", "shard", "digest", "sha"]
    run = rows.groupBy(*key).agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("order"), "doc_id", "row")).alias("best"), F.count("*").alias("n"))
    nodes = leaves
    while nodes > 1:
        nodes = -(-nodes // fan)
        run = run.withColumn("node", F.floor(F.col("node") / fan).cast("int")).repartition("node", "shard").sortWithinPartitions(*key)
        run = run.groupBy(*key).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    root = run.select("digest", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))

    held = rows.select(*key).distinct()
    winners = held.join(root, ["digest", "sha"])
    out = rows.join(winners, key)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8) -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns.

    Where ids name rows, the ids of those that go decide, so texts needn't be shuffled. Rows with a null id or one that repeats are told apart by id and text.
    """
    found = materialize(exact_dedup(df, id_col, text_col, fan), "dedup-found")
    shared = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "dedup-shared")
    named = found if shared.isEmpty() else found.join(shared, "doc_id", "left_anti")
    gone = materialize(named.where("NOT kept").select("doc_id"), "dedup-gone")
    if shared.isEmpty():
        return without_ids(df, id_col, gone)

    key, null, mark, best = (free_name(df, x) for x in ("row_key", "row_null", "row_mark", "row_best"))
    number = lambda c: [F.coalesce(c, F.lit(0).cast("bigint")).alias(key), c.isNull().alias(null)]
    keyed = df.select("*", *number(F.col(f"`{id_col}`").cast("bigint")))
    doubtful = shared.select(*number(F.col("doc_id")))
    sure = without_ids(keyed.join(doubtful, [key, null], "left_anti"), id_col, gone)
    winners = found.where("kept").select(*number(F.col("doc_id")), F.unhex("text_sha256").alias(mark))
    others = keyed.join(doubtful, [key, null], "left_semi").withColumn(mark, F.unhex(F.sha2(normalised(text_col), 256))).join(winners, [key, null, mark], "left_semi")
    # Rows that repeat an id and a text are reduced before they are shuffled; the longest is the winner.
    columns = [F.col(f"`{c}`") for c in df.columns]
    longest = F.max_by(F.struct(*columns), F.length(text_of(text_col))).alias(best)
    others = others.groupBy(key, null, mark).agg(longest)
    return sure.select(*columns).unionByName(others.select(*(F.col(best).getField(c).alias(c) for c in df.columns)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load_table(spark, sf_dir, "documents")).drop("n_chars")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents
), w AS (
  SELECT doc_id, sha, first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM w
"""
