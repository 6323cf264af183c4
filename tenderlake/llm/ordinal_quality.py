"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has one score, the sum of hashed weights over its words, their beginnings and ends, and its shape, each feature once. Ordered
thresholds cut the score into grades: ``P(grade >= k) = sigmoid(score - threshold[k])``, with the weights shared by all grades. From
that follow the expected grade and the tail probability of the best grade, by which documents are selected.

Ratings: 0 for a document of low quality, 1 for a toxic one of good quality, 2 for a good one.
A test picks the features that the ratings speak about; their weights are fitted by proximal gradient steps with an L1 penalty. All others
weigh nothing, so long texts gather no noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import SAMPLE_BYTES, arrow_fields, free_name, map_batches, map_rows, text_of, within_bytes
from tenderlake.sources.tables import discard, load_table, materialize

WORD = re.compile(r"\w+")
#: A word that begins with a sign, and one that ends in several.
BARE = re.compile(r"(?<!\S)[^\w\s]")
TAIL = re.compile(r"[^\w\s]{2}(?!\S)")
SHAPES = ("distinct", "capitals", "signs", "bare", "tails", "length", "size")
BUCKETS = 1 << 22
GRADES = 3


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_buckets(word: str) -> tuple[int, ...]:
    """Of a word, of its first four letters and of its last four."""
    return bucket("w " + word), bucket("p " + word[:4]), bucket("e " + word[-4:])


def shape(text: str) -> list[str]:
    """How the text looks, in coarse steps: repetition, capitals, signs, length of words and text. Bytes beyond ASCII count as letters."""
    words = text.split()
    if not words:
        return ["empty"]
    n = len(words)
    step = lambda name, share: f"{name} {min(9, int(10 * share))}"
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    capitals, small, digits = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum(), counts[48:58].sum()
    size = counts[33:].sum() or 1
    return [
        step("distinct", len(set(words)) / n),
        step("capitals", capitals / (capitals + small or 1)),
        step("signs", 1 - (capitals + small + digits) / size),
        step("bare", len(BARE.findall(text)) / n),
        step("tails", len(TAIL.findall(text)) / n),
        f"length {min(20, len(text) // n)}",
        f"size {min(n.bit_length(), 5)}",
    ]


def buckets_of(text: str) -> list[int]:
    """The hashed features that a text has, each once."""
    out = {b for w in set(WORD.findall(text.lower())) for b in word_buckets(w)}
    out.update(bucket("s " + x) for x in shape(text))
    return sorted(out)


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    thresholds: list[float]
    #: The tail probability from which a document is kept, as ratings tell it that the weights were not fitted on.
    keep_at: float = 0.5

    def scorer(self, most: int = 80_000) -> Callable[[str], float]:
        """A function from text to score, which remembers for up to ``most`` words which of their features weigh anything."""
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str) -> float:
            if len(known) > most:
                known.clear()
            held: set[int] = set()
            for w in set(WORD.findall(text.lower())):
                x = known.get(w)
                if x is None:
                    x = known[w] = tuple(b for b in word_buckets(w) if b in weights)
                if x:
                    held.update(x)
            held.update(b for x in shape(text) if (b := bucket("s " + x)) in weights)
            return sum(weights[b] for b in sorted(held))

        return score

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k from 1."""
        return [float(1 / (1 + np.exp(-np.clip(score - t, -50, 50)))) for t in self.thresholds]


def telling(names: np.ndarray, counts: np.ndarray, grades: np.ndarray, sure: float) -> np.ndarray:
    """Which of the buckets ``names`` take part: all of the shape, and the words' that speak against a document. ``counts`` has for each grade how many of its rows have them.

    Those are more frequent in a lower grade than in the others by ``sure`` standard errors. A text is good unless something speaks against
    it; words that are merely common in good texts would tell long from short ones instead. Rows of a negative grade don't count.
    """
    total, rows = counts.sum(0), int((grades >= 0).sum())
    out = np.isin(names, [bucket(f"s {name} {i}") for name in SHAPES for i in range(32)] + [bucket("s empty")])
    for k in range(GRADES - 1):
        inside = int((grades == k).sum())
        outside = rows - inside
        if inside and outside:
            share = total / rows
            error = np.sqrt(share * (1 - share) * (1 / inside + 1 / outside)) + 1e-12
            out |= counts[k] / inside - (total - counts[k]) / outside > sure * error
    return out


def held_back(rows: int) -> np.ndarray:
    """Every fifth row: the weights aren't fitted on it."""
    return np.arange(rows) % 5 == 4


def flat_features(batch: pa.RecordBatch, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a batch (``rated_id, buckets``), one row's behind another's, and the place of each one's row among the sorted ``ids``."""
    buckets = batch.column(1)
    owner = np.searchsorted(ids, batch.column(0).to_numpy()).astype(np.int32)
    return buckets.flatten().to_numpy(), np.repeat(owner, buckets.value_lengths().to_numpy(zero_copy_only=False))


def telling_features(features: DataFrame, ids: np.ndarray, grades: np.ndarray, least: int = 3, sure: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a written sample (``rated_id, buckets``), whose sorted ``ids`` have ``grades``: the names of the telling buckets of at least ``least`` rows; and for each time one is met its place among those and its row.

    Buckets are counted by tasks and chosen by tasks; the driver gets the telling ones alone, which are few.
    """
    judged = np.where(held_back(len(grades)), -1, grades).astype(np.int8)
    counted = arrow_fields(bucket=pa.int32(), n="long", **{f"n{k}": "long" for k in range(GRADES)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner = flat_features(batch, ids)
            names, place = np.unique(flat, return_inverse=True)
            grade = judged[owner]
            n = [np.bincount(place, minlength=len(names)), *(np.bincount(place[grade == k], minlength=len(names)) for k in range(GRADES))]
            yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, n)], schema=counted)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column(0).to_numpy(), np.array([batch.column(k + 2).to_numpy() for k in range(GRADES)], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(names[telling(names, counts, judged, sure)])], schema=pa.schema([counted.field("bucket")]))

    totals = map_batches(features, counted, count).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in counted.names[1:])).where(F.col("n") >= least)
    names = np.sort(map_batches(totals, pa.schema([counted.field("bucket")]), choose).toArrow()["bucket"].to_numpy())
    met = arrow_fields(place=pa.int32(), owner=pa.int32())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner = flat_features(batch, ids)
            place = np.searchsorted(names, flat).astype(np.int32)
            known = np.append(names, -1)[place] == flat
            yield pa.RecordBatch.from_arrays([pa.array(place[known]), pa.array(owner[known])], schema=met)

    found = map_batches(features, met, meet).toArrow()
    return names, found["place"].to_numpy(), found["owner"].to_numpy()


def fit(names: np.ndarray, at: np.ndarray, owner: np.ndarray, grades: np.ndarray, penalty: float = 1e-4, steps: int = 800, rate: float = 0.3, balance: float = 0.5) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty over the telling features ``names``.

    ``at`` has the places of all rows' features among those, ``owner`` the row of each. ``balance`` 1 gives all grades the same weight together, 0 all rows.
    Rows that are held back tell where to cut, if there are good and other ones among them; else all rows do.
    """
    held = held_back(len(grades))
    # Sums of floating point numbers depend on their order, so that is fixed.
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    n = np.bincount(grades[~held], minlength=GRADES)
    share = (np.maximum(n, 1.0) ** -balance)[grades] * ~held
    share /= share.sum()
    weights, gaps = np.zeros(len(names)), np.array([-1.0, np.log(2.0)])  # the first threshold, and the logarithm of the distance to the next
    squares, gap_squares = np.zeros(len(names)), np.zeros(len(gaps))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for _ in range(steps):
        score = np.bincount(owner, weights[at], len(grades))
        cuts = np.array([gaps[0], gaps[0] + np.exp(gaps[1])])
        s = sigmoid(score[:, None] - cuts)  # P(grade >= 1), P(grade >= 2)
        d = s * (1 - s)
        p = np.stack([1 - s[:, 0], s[:, 0] - s[:, 1], s[:, 1]], 1)[np.arange(len(grades)), grades].clip(1e-12)
        # The likelihood's slope by each of s, for the row's own grade.
        by_s = np.stack([np.where(grades == 0, -1.0, np.where(grades == 1, 1.0, 0.0)), np.where(grades == 2, 1.0, np.where(grades == 1, -1.0, 0.0))], 1)
        slope = -share[:, None] * by_s * d / p[:, None]
        grad = np.bincount(at, slope.sum(1)[owner], len(names))
        gap_grad = np.array([-slope.sum(), -slope[:, 1].sum() * np.exp(gaps[1])])
        squares += grad**2
        gap_squares += gap_grad**2
        pace = rate / (np.sqrt(squares) + 1e-9)
        weights -= pace * grad
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - pace * penalty)
        gaps -= rate * gap_grad / (np.sqrt(gap_squares) + 1e-9)
    weighty = np.flatnonzero(weights)
    model = OrdinalModel(dict(zip(names[weighty].tolist(), weights[weighty].tolist(), strict=True)), [float(gaps[0]), float(gaps[0] + np.exp(gaps[1]))])
    tails, good = np.array([model.tails(x)[-1] for x in np.bincount(owner, weights[at], len(grades))]), grades == GRADES - 1
    judges = held if 0 < good[held].sum() < held.sum() else np.ones(len(grades), bool)
    model.keep_at = best_cut(tails[judges], good[judges])
    return model


def best_cut(tails: np.ndarray, good: np.ndarray) -> float:
    """The probability that parts the good from the others with the best mean of both hit rates; 0.5 if one of them is missing."""
    if good.all() or not good.any():
        return 0.5
    order = np.argsort(tails, kind="stable")
    lost = np.cumsum(good[order]) / good.sum()
    caught = np.cumsum(~good[order]) / (~good).sum()
    gain = np.where(np.append(tails[order][1:] > tails[order][:-1], False), caught - lost, -1)
    best = int(np.argmax(gain))
    return float((tails[order][best] + tails[order][best + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents and ``sample_bytes`` of their texts: those whose ids hash lowest, so the same ones at each run and in any order of rows.

    ``labels`` has ``doc_id``, ``quality`` (0 or 1; null: not rated) and ``toxic`` (null: 0). Of rows that repeat an id the lowest grade counts, and
    one of its texts. Of the sample's hashed features only the telling ones come to the driver. The sample's texts, then its features, are written while the model is fitted.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).cast("bigint")
    rated = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("rated_id")).agg(F.min(grade).alias("grade"))
    rated = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("rated_id"), text_of(text_col).alias("body")).join(F.broadcast(rated), "rated_id")
    rows = within_bytes(rows.groupBy("rated_id", "grade").agg(F.max("body").alias("body")), "rated_id", sample_bytes)
    schema = arrow_fields(rated_id="long", grade="long", buckets=pa.list_(pa.int32()))
    features = materialize(map_rows(rows, schema, lambda: lambda ids, grades, texts: [ids, grades, [buckets_of(t) for t in texts]]), "sample-features")
    discard(rows)
    rated = features.select("rated_id", "grade").toArrow().sort_by("rated_id")
    ids, grades = rated["rated_id"].to_numpy(), rated["grade"].to_numpy()
    model = fit(*telling_features(features.select("rated_id", "buckets"), ids, grades), grades) if len(ids) else OrdinalModel({}, [0.0] * (GRADES - 1))
    discard(features)
    return model


SCHEMA = arrow_fields(doc_id="long", score="real", expected_grade="real", tail_probability="real", kept="flag")


def grade_documents(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_at: float | None = None) -> DataFrame:
    """One row for each row of ``df``: score, expected grade, tail probability of the best grade, and whether that reaches ``keep_at`` (the model's own if none is given).

    Whole texts are read. A null text counts as empty; a null id stays null; repeated rows and equal texts get equal values; other columns aren't
    read; an empty table gives an empty result. A model fitted on no rating at all
    scores 0, a tail probability of 0.5, and so keeps all.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep_at = model.keep_at if keep_at is None else keep_at

    def make():
        model = shared.value
        score = model.scorer()

        def work(ids: list, texts: list[str]) -> list[list]:
            scores = [score(t) for t in texts]
            tails = [model.tails(s) for s in scores]
            return [ids, scores, [sum(t) for t in tails], [t[-1] for t in tails], [t[-1] >= keep_at for t in tails]]

        return work

    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), SCHEMA, make)


def keep_good(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep_at: float | None = None) -> DataFrame:
    """The rows of ``df`` whose tail probability reaches ``keep_at``, with all their columns, whatever their names, in one pass without a join.

    Whole texts are read; a null text counts as empty; ids aren't read, so null and repeated ones are judged by their texts; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep_at = model.keep_at if keep_at is None else keep_at
    known: list = []

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(shared.value.scorer())
        return texts.map(lambda t: shared.value.tails(known[0](t))[-1] >= keep_at)

    mark = free_name(df, "good_enough")
    return df.withColumn(mark, good(text_of(text_col))).where(F.col(mark)).select(*(F.col(f"`{c}`") for c in df.columns))


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return grade_documents(docs, train(docs, load_table(spark, sf_dir, "labels")))
