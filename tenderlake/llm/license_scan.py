"""License scan by diagonal voting.

Every run of ``K`` words of every document is hashed by a rolling sum and meets, in a Spark join, the same runs of the license templates; a hit counts only if
the words are equal as well as the hash. A hit is a vote for a diagonal: the place in the document less the place in the template. Votes are summed by diagonal. A phrase stands where
its diagonal has all of the phrase's votes. For a notice, neighbouring diagonals (an added or a left out word shifts the rest to the next one) are merged to bands, and the
span of a band is verified by the part of the template's words that its votes cover.

Only templates are broadcast, and only after they have been counted. Documents are read once, their words never leave the join, and hits are shuffled once, by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_batches, text_of
from tenderlake.sources.tables import load_table

K = 3
#: Of lower-cased UTF-8: letters and digits of ASCII, and whatever lies beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The phrases that count as base places, with their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices as licensors publish them, for the labels that voting adds.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
GRAMS = arrow_fields(row="long", id="long", n_words="long", at="long", hash="long", gram="bytes")


def word_runs(df: DataFrame, id_col: str, text_col: str, k: int = K, slice_words: int = 200_000) -> DataFrame:
    """``row, id, n_words, at, hash, gram``: for each row of ``df`` one row with its number of words (``at`` null), and one for each ``k`` words in a row.

    ``row`` is the place of the row in the input, so rows that repeat an id stay apart; it is the same if a task is run again over the same files.
    """

    def batch_of(ids: list[tuple[int, int | None]], texts: list[list[bytes]], memo: dict[bytes, int]) -> pa.RecordBatch:
        counts = np.array([len(w) for w in texts], np.int64)
        flat = [x for w in texts for x in w]
        for w in {*flat} - memo.keys():
            memo[w] = xxhash.xxh64_intdigest(w)
        keys = np.fromiter((memo[w] for w in flat), np.uint64, len(flat))
        runs = np.maximum(counts - k + 1, 0)
        first = np.cumsum(counts) - counts
        # Places of the first words of all runs, document by document.
        at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        place = at + np.repeat(first, runs)
        rolled = np.zeros(len(place), np.uint64)
        for j in range(k):
            rolled = rolled * FACTOR + keys[place + j]
        grams = []
        for w in texts:
            if len(w) >= k:
                line = b" ".join(w)
                ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
                starts = np.append(0, ends[:-1] + 1)[: len(w) - k + 1].tolist()
                grams += [line[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
        rows, names = np.array([r for r, _ in ids], np.int64), pa.array([i for _, i in ids], pa.int64())
        owner = np.repeat(np.arange(len(ids)), runs)
        none = pa.nulls(len(ids), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(rows), pa.array(rows[owner])]),
            pa.concat_arrays([names, names.take(pa.array(owner))]),
            pa.concat_arrays([pa.array(counts), pa.array(counts[owner])]),
            pa.concat_arrays([none, pa.array(at)]),
            # A document's own row joins nothing; its key spreads such rows should the join be shuffled.
            pa.concat_arrays([pa.array(rows), pa.array(rolled.view(np.int64))]),
            pa.concat_arrays([pa.nulls(len(ids), pa.binary()), pa.array(grams, pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            ids, texts, held = [], [], 0
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = WORD.findall(text.encode().lower())
                ids.append((row, doc))
                texts.append(words)
                held += len(words)
                if held >= slice_words:
                    yield batch_of(ids, texts, memo)
                    ids, texts, held = [], [], 0
                    if len(memo) > 500_000:
                        memo.clear()
            if ids:
                yield batch_of(ids, texts, memo)

    return map_batches(df.select(F.monotonically_increasing_id(), F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), GRAMS, run)


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``template, label, text, exact``."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in notices]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template bigint, label string, text string, exact boolean")


def scan_licenses(df: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slack: int = 3, least: float = 0.8, most: int = 1_000_000) -> DataFrame:
    """``row, id, n_words``, and ``spans``: one for each phrase or notice that was found, as ``template, label, exact, first_word, last_word, coverage``; bands below ``least`` are there too.

    ``templates`` has ``template`` (a number for each), ``label``, ``text`` and ``exact``: true for a phrase, which has to stand word for word, false for a notice, of whose words the part ``least``
    must be covered. Templates of fewer than ``k`` words are an error. Up to ``most`` runs of template words are broadcast; beyond that Spark shuffles both sides of the join.

    A null text counts as empty, a text without words has no spans, however long a text is all of it is read. Null ids stay null; rows that repeat are scanned each by itself; an empty table
    gives an empty result; other columns aren't read, whatever their names. Places of a phrase may overlap. ``first_word`` counts from 0, ``last_word`` is inclusive.
    """
    known = word_runs(templates, "template", "text", k)
    sizes = known.where("at IS NULL").select(F.col("id").alias("template"), F.col("n_words").alias("size"))
    too_short = F.raise_error(F.concat(F.lit(f"a template has fewer than {k} words: "), F.col("template").cast("string")))
    sizes = sizes.withColumn("size", F.when(F.col("size") >= k, F.col("size")).otherwise(too_short))
    about = templates.select("template", "label", "exact").join(sizes, "template")
    places = known.where("at IS NOT NULL").select(F.col("id").alias("template"), F.col("at").alias("place"), F.col("hash").alias("_hash"), F.col("gram").alias("_gram")).join(about, "template")
    places = F.broadcast(places) if places.count() <= most else places

    runs = word_runs(df, id_col, text_col, k)
    hits = runs.join(places, (F.col("hash") == F.col("_hash")) & (F.col("gram") == F.col("_gram")), "left").where("at IS NULL OR template IS NOT NULL")
    hits = hits.select("row", "id", "n_words", "template", "label", "exact", "size", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    # One shuffle by document serves all that follows.
    votes = hits.repartition("row").groupBy("row", "id", "n_words", "template", "label", "exact", "size", "diagonal").agg(F.collect_list("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > slack)
    bands = votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("_new").over(order))
    whole = bands.groupBy("row", "id", "n_words", "template", "label", "exact", "size", "band").agg(
        F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("places") + (k - 1)).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    span = F.struct("template", "label", "exact", "first_word", "last_word", (covered / F.col("size")).alias("coverage"))
    # A phrase counts only where it is whole.
    real = F.col("template").isNotNull() & (~F.col("exact") | (covered == F.col("size")))
    return whole.groupBy("row", "id", "n_words").agg(F.collect_list(F.when(real, span)).alias("spans"))


def label_licenses(scanned: DataFrame, least: float = 0.8) -> DataFrame:
    """From :func:`scan_licenses`: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; the score is the best coverage of any template."""
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first_word"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    found = F.filter("spans", lambda s: s["exact"] | (s["coverage"] >= least))
    return scanned.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(found).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_licenses(scan_licenses(load_table(spark, sf_dir, "documents"), template_table(spark)))
