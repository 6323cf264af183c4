"""Bloom filters as tables, and an anti-join that asks a stored manifest only about names that its filter can't rule out.

A filter is a table of 64-bit words, ``word`` (its number) and ``mask`` (its bits). A name falls on one word and sets up to five of its bits, so building is a grouped ``bit_or`` that tasks begin before
anything is shuffled, and filters of one size merge by the same ``bit_or``. A name that is in the filter always shows; one that isn't shows seldom, and whatever shows is settled exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.sources.tables import materialize

SCHEMA = "word long, mask long"
#: Words that go to every executor: two numbers each.
BROADCAST_WORDS = 1 << 20
#: Names for each word of 64 bits; about one name in a hundred and fifty then shows without being there.
NAMES_PER_WORD = 4


def words_for(names: int) -> int:
    """Words of a filter that is to hold so many names. More may be put into it: it rules out less then, and nothing gets wrong."""
    return max(1, -(-names // NAMES_PER_WORD))


def _place(name: str, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.col(name), F.lit(1))
    # Six bits of the hash say which of a word's bits is set.
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(5)]
    return F.pmod(F.xxhash64(F.col(name)), F.lit(words)), reduce(Column.bitwiseOR, bits)


def bloom_filter(names: DataFrame, name: str, words: int) -> DataFrame:
    """The filter of the column's values. Nulls aren't in it; an empty table gives an empty filter."""
    word, mask = _place(name, words)
    return merged(names.where(F.col(name).isNotNull()).select(word.alias("word"), mask.alias("mask")))


def merged(words: DataFrame) -> DataFrame:
    """One filter of the rows of several of one size."""
    return words.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def mark_possible(rows: DataFrame, filters: DataFrame, name: str, words: int, flag: str = "possible") -> DataFrame:
    """``rows`` with a flag: false where the name is surely in none of ``filters`` (rows of one or more filters of ``words`` words, not merged yet). A null name is in none.

    Of the filters only the words that the names fall on are read on; they are shuffled only if there are more than :data:`BROADCAST_WORDS` of those. ``rows`` should be written already: they are read
    three times.
    """
    word, mask = _place(name, words)
    asked = rows.where(F.col(name).isNotNull()).select(word.alias("word")).distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_WORDS else asked.hint("shuffle_hash")
    held = merged(filters.join(asked, "word", "left_semi")).select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    placed = rows.withColumns({"_at": word, "_bits": mask}).join(held, F.col("_at") == F.col("_word"), "left")
    found = F.coalesce(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)) & F.col(name).isNotNull()
    return placed.select(*rows.columns, found.alias(flag))


def missing_from(rows: DataFrame, stored: DataFrame, filters: DataFrame, name: str, words: int) -> DataFrame:
    """The rows whose name the table ``stored`` lacks, as an anti-join gives them; a null name is always missing. ``filters`` hold all of the stored names.

    Names that the filters rule out go past ``stored``. Of the others a filter is made and sent to it, so that of its rows only those that may match are shuffled; if no name is left, it isn't
    read at all. Names should be distinct in ``rows``. Jobs run while the result is built.
    """
    flagged = materialize(mark_possible(materialize(rows, "new-names"), filters, name, words), "flagged-names")
    new, doubtful = flagged.where("NOT possible").drop("possible"), flagged.where("possible").drop("possible")
    n = doubtful.count()
    if not n:
        return new
    candidates = stored.select(name)
    own = words_for(n)
    if own <= BROADCAST_WORDS:
        word, mask = _place(name, own)
        held = F.broadcast(bloom_filter(doubtful, name, own).select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
        met = (F.col("_mask").bitwiseAND(mask)) == mask
        candidates = candidates.join(held, (word == F.col("_word")) & met, "left_semi")
    # A name may be stored many times; it is one row before it is shuffled.
    return new.unionByName(doubtful.join(candidates.distinct(), name, "left_anti").select(*rows.columns))
