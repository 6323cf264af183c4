"""The section map of paged documents: each line gets the section it stands in, by the best path through the lines.

A line speaks for a section by words that the section uses, and for its beginning by words of its title, the more so if the line looks like a heading. Going on in a section is free, changing to another one costs.
The best path through all lines of a document is found across its pages without bringing the pages together: a page is reduced to a small matrix, the best gain from each section before it to
each section at its end. Only these matrices are gathered by document, where they say in which section each page begins and ends; then each page finds its own part of the path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.sources.shipping import ship_package
from tenderlake.sources.tables import materialize

#: Ranks of paths are below this.
BIG = 1 << 20
NEVER = -(1 << 60)


@dataclass(frozen=True)
class Section:
    """``title``: words of its heading, ``words``: words that its lines use; all in lower case."""

    name: str
    title: tuple[str, ...]
    words: tuple[str, ...] = ()


#: The sections that the bulletin's first page names.
BULLETIN = (
    Section("Résultats", ("résultats",), ("attributaire", "attribué", "montant", "offres reçues", "infructueux")),
    Section("Marchés de fournitures et services courants", ("marchés", "fournitures", "services"), ("fourniture", "acquisition", "prestation", "services")),
    Section("Marchés de travaux", ("marchés", "travaux"), ("travaux", "construction", "réhabilitation", "bitumage")),
)


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def line_gains(line: Column, sections: Sequence[Section]) -> Column:
    """For no section and each section what the line gains in it, then what it gains by beginning there."""
    low = F.lower(line)
    short = F.trim(line)
    heading = (F.length(short) > 0) & (F.length(short) <= 80) & ~short.rlike(r"[.;,]$")
    has = lambda w: F.contains(low, F.lit(w)).cast("int")
    inside = [2 * _sum([has(w) for w in s.words]) for s in sections]
    begins = [F.floor(6 * _sum([has(w) for w in s.title]) / len(s.title)).cast("int") * F.when(heading, 2).otherwise(1) for s in sections]
    return F.array(F.lit(0), *inside, F.lit(0), *begins).cast("array<int>")


def steps_of(gains: np.ndarray, switch: int) -> np.ndarray:
    """For each line what it gains when the line before stood in section k and it stands in section j."""
    n = gains.shape[1] // 2
    inside, begins = gains[:, None, :n], gains[:, None, n:] - switch
    return inside + np.where(np.eye(n, dtype=bool), 0, begins)


def matrix(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each section before the lines to each section of the last one: the gain of the best path, and its rank among these best paths in the order of their sections. Of equally good paths the first counts."""
    n = steps.shape[1]
    gain, rank = np.where(np.eye(n, dtype=bool), 0, NEVER), np.zeros((n, n), np.int64)
    for step in steps:
        gain, rank, _ = advance(gain, rank, step)
    return gain, rank


def advance(gain: np.ndarray, rank: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One line further; also which section each path comes from."""
    n = step.shape[0]
    reached = np.where(gain[:, :, None] <= NEVER // 2, NEVER, (gain[:, :, None] + step) * BIG - rank[:, :, None])
    source = reached.argmax(axis=1)
    best = np.take_along_axis(reached, source[:, None, :], 1)[:, 0, :]
    gain = -(-best // BIG)
    before = gain * BIG - best
    _, rank = np.unique(before * n + np.arange(n), return_inverse=True)
    return gain, rank.reshape(gain.shape), source


def path(steps: np.ndarray, first: int, last: int) -> list[int]:
    """The best path from section ``first`` before the lines to ``last`` on the last one."""
    n = steps.shape[1]
    gain, rank, sources = np.where(np.arange(n) == first, 0, NEVER)[None, :], np.zeros((1, n), np.int64), []
    for step in steps:
        gain, rank, source = advance(gain, rank, step)
        sources.append(source[0])
    out = [last]
    for source in reversed(sources[1:]):
        out.append(int(source[out[-1]]))
    return out[::-1]


def join_pages(gains: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
    """For each page, from its matrices in order, the sections before it and at its end on the best path of the document, which begins in none."""
    n = gains.shape[1]
    gain, rank, sources = np.where(np.arange(n) == 0, 0, NEVER), np.zeros(n, np.int64), []
    for g, r in zip(gains, ranks, strict=True):
        total = np.where(gain[:, None] <= NEVER // 2, NEVER, gain[:, None] + g)
        order = rank[:, None] * np.int64(n * n + 1) + r
        best = total.max(axis=0)
        first = np.where(total == best, order, np.iinfo(np.int64).max)
        source = first.argmin(axis=0)
        _, rank = np.unique(first.min(axis=0), return_inverse=True)
        gain = best
        sources.append(source)
    top = np.flatnonzero(gain == gain.max())
    at = int(top[rank[top].argmin()])
    out = []
    for source in reversed(sources):
        out.append((int(source[at]), at))
        at = int(source[at])
    return out[::-1]


def section_lines(pages: DataFrame, sections: Sequence[Section] = BULLETIN, doc: str = "doc_id", page: str = "page_no", text: str = "text", switch: int = 8, lines: str = "\n") -> DataFrame:
    """``doc, page, line`` (from 0 on its page) and ``section`` (null before the first) of each line. ``lines``: a pattern of what stands between lines.

    A null text is one empty line. Pages are in order of ``page``; of one document each number comes once, and the number isn't null. Rows of a null ``doc`` are one document. At most 60 sections. Jobs run while
    the result is built: one that writes what each line gains, and one that writes what the pages' matrices say.
    """
    n = len(sections) + 1
    if n > 61:
        raise ValueError("more than 60 sections")
    ship_package(pages.sparkSession)
    split = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), lines)
    scored = materialize(pages.select(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), F.flatten(F.transform(split, lambda x: line_gains(x, sections))).alias("gains")), "section-gains")
    steps = lambda flat: steps_of(np.asarray(flat, np.int64).reshape(-1, 2 * n), switch)

    def reduce_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [matrix(steps(g)) for g in batch.column("gains").to_pylist()]
            columns = [pa.array([m[i].ravel().tolist() for m in made], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), *columns], ["doc", "page", "gain", "rank"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page")
        square = lambda c: np.array(part[c].tolist(), np.int64).reshape(len(part), n, n)
        ends = join_pages(square("gain"), square("rank"))
        return pd.DataFrame({"doc": part["doc"], "page": part["page"], "first": [a for a, _ in ends], "last": [b for _, b in ends]})

    kind = scored.schema["doc"].dataType.simpleString()
    matrices = scored.mapInArrow(reduce_pages, f"doc {kind}, page long, gain array<long>, rank array<long>")
    ends = materialize(matrices.groupBy("doc").applyInPandas(join, f"doc {kind}, page long, first int, last int"), "section-ends")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("gains", "first", "last"))
            paths = [path(steps(g), a, b) for g, a, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), pa.array(paths, pa.list_(pa.int32()))], ["doc", "page", "path"])

    side = ends.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), "first", "last")
    met = scored.join(side, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("page") == F.col("_page"))).select("doc", "page", "gains", "first", "last")
    found = met.mapInArrow(follow, f"doc {kind}, page long, path array<int>").select(F.col("doc").alias(doc), F.col("page").alias(page), F.posexplode("path").alias("line", "_at"))
    names = F.array(F.lit(None).cast("string"), *(F.lit(s.name) for s in sections))
    return found.select(doc, page, "line", F.element_at(names, F.col("_at") + 1).alias("section"))


def stretches(lines: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """From :func:`section_lines`: each stretch of lines in one section, ``doc, section, first_page, last_page, n_lines``, numbered by ``part`` from 1 in each document. Lines without a section are no stretch."""
    # Pages are reduced to the changes within them before a document's are put in order.
    place = Window.partitionBy(doc, page).orderBy("line")
    starts = lines.withColumn("_new", (~F.col("section").eqNullSafe(F.lag("section").over(place)) | (F.lag("line").over(place).isNull())).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(place)).groupBy(doc, page, "_run").agg(F.first("section").alias("section"), F.count("*").alias("_lines"))
    order = Window.partitionBy(doc).orderBy(page, "_run")
    joined = runs.withColumn("_new", (~F.col("section").eqNullSafe(F.lag("section").over(order)) & F.col("section").isNotNull()).cast("int"))
    numbered = joined.withColumn("part", F.sum("_new").over(order)).where("section IS NOT NULL")
    return numbered.groupBy(doc, "part", "section").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.sum("_lines").alias("n_lines")).select(doc, F.col("part").cast("int").alias("part"), "section", "first_page", "last_page", "n_lines")


def section_map(lines: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """``doc`` and ``sections``: a map from each section to its first and last page. Documents without any have an empty map."""
    pages = lines.groupBy(doc, "section").agg(F.min(page).alias("_a"), F.max(page).alias("_b"))
    entry = F.when(F.col("section").isNotNull(), F.struct("section", F.array("_a", "_b").alias("pages")))
    return pages.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sections"))
