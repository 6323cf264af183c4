"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A word, written ``<word>``, has its whole and its runs of two to four letters as subwords. Each falls in a bucket with an embedding; a text is the mean of the embeddings of all its subwords,
and a linear layer with a softmax gives the languages' probabilities. Both are trained by stochastic gradient descent in numpy.
A part of the sample is held back: on it a temperature is fitted, so that scores are probabilities, and the least score at which predictions are as often right as asked for.

Since mean and layer are linear, a word's subwords add up to one row of sums; each worker keeps those of the words that it has met.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import SAMPLE_BYTES, arrow_fields, map_rows, text_of, within_bytes
from tenderlake.sources.tables import discard, load_table

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
UNKNOWN = "und"


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    parts = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def words_of(text: str | None) -> Counter[str]:
    """The words of a text and how often each stands there; none if it has no letter (``\\w`` also knows numbers that are not digits)."""
    words = Counter(WORD.findall((text or "").lower()))
    return words if any(any(map(str.isalpha, w)) for w in words) else Counter()


def bucket_counts(text: str) -> tuple[list[int], list[int]]:
    counts: Counter[int] = Counter()
    for word, n in words_of(text).items():
        for b in subwords(word):
            counts[b] += n
    return list(counts), list(counts.values())


@dataclass
class LanguageModel:
    """``table`` has for each bucket what it adds to each language's logit, ``bias`` the rest."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    reject_below: float = 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], size: int = 16, epochs: int = 6, rate: float = 1.0, precision: float = 0.99, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over four fifths of the rows (buckets, counts); the others calibrate."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel()
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    held = np.arange(len(y)) % 5 == 4
    table = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    layer, bias = np.zeros((size, len(names)), np.float32), np.zeros(len(names))
    shares = [(c / c.sum()).astype(np.float32) for _, c in rows]
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for i in rng.permutation(np.flatnonzero(~held)):
            at, share = rows[i][0], shares[i]
            mean = share @ table[at]
            error = softmax(mean @ layer + bias)
            error[y[i]] -= 1
            back = layer @ error
            layer -= pace * np.outer(mean, error)
            bias -= 0.1 * pace * error
            # A bucket's own share is small; scaled to the text's largest, rare and frequent ones both move.
            table[at] -= pace * np.outer(share / share.max(), back).astype(np.float32)
    model = LanguageModel(names, (table @ layer).astype(np.float32), bias)
    check = np.flatnonzero(held)
    if len(check):
        logits = np.array([shares[i] @ model.table[rows[i][0]] for i in check]) + bias
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(logits / model.temperature)
        score, right = p.max(1), p.argmax(1) == y[check]
        order = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
        model.reject_below = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Fit on at most ``sample`` of ``docs`` and ``sample_bytes`` of their texts, of those with a text and a language: those whose ids hash lowest, one row for each id. Only hashed counts come to the driver.

    A fifth of them calibrates temperature and rejection (``reject_below``); of fewer than five none does, and nothing is rejected.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    chosen = known.select(F.col(f"`{id_col}`").alias("chosen_id")).distinct().orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(sample)
    rows = known.join(F.broadcast(chosen), F.col(f"`{id_col}`").eqNullSafe(F.col("chosen_id"))).select(F.col("chosen_id").cast("bigint"), F.struct(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(text_col).alias("body")).alias("row"))
    rows = within_bytes(rows.groupBy("chosen_id").agg(F.max("row").alias("row")).select("chosen_id", "row.*"), "chosen_id", sample_bytes)
    schema = arrow_fields(chosen_id="long", lang="text", buckets=pa.list_(pa.int32()), counts=pa.list_(pa.int32()))

    def make():
        def work(ids: list, langs: list[str], texts: list[str]) -> list[list]:
            return [ids, langs, *map(list, zip(*(bucket_counts(t) for t in texts), strict=True))]

        return work

    found = map_rows(rows, schema, make).toArrow().combine_chunks()
    discard(rows)
    if not found.num_rows:
        return LanguageModel()
    ids = [(-1 if i is None else i, lang) for i, lang in zip(found["chosen_id"].to_pylist(), found["lang"].to_pylist(), strict=True)]
    cut = lambda name: np.split((c := found[name].combine_chunks()).flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1])
    at, counts = cut("buckets"), cut("counts")
    order = [i for i in sorted(range(len(ids)), key=lambda i: (ids[i], len(at[i]), int(counts[i].sum()))) if len(at[i])]
    return fit([(at[i], counts[i]) for i in order], [ids[i][1] for i in order])


class WordSums:
    """For each word met, what its subwords add to the logits and how many they are."""

    def __init__(self, model: LanguageModel, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.empty((1024, len(self.model.languages) + 1))

    def logits(self, words: Counter[str]) -> np.ndarray:
        if len(self.rows) > self.most:
            self.forget()
        for w in [w for w in words if w not in self.rows]:
            at = len(self.rows)
            if at == len(self.sums):
                self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
            parts = subwords(w)
            self.sums[at, :-1] = self.model.table[parts].sum(0)
            self.sums[at, -1] = len(parts)
            self.rows[w] = at
        total = np.fromiter(words.values(), float, len(words)) @ self.sums[np.fromiter(map(self.rows.__getitem__, words), int, len(words))]
        return total[:-1] / total[-1] + self.model.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(words) / self.model.temperature)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best])


SCHEMA = arrow_fields(doc_id="long", lang_pred="text", score="real", accepted="flag")


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for each row of ``df``, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and not accepted; else the prediction is accepted if its
    score reaches the calibrated threshold. A null id stays null; equal texts get equal values; other columns aren't read; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        sums = WordSums(shared.value)

        def work(ids: list, texts: list[str | None]) -> list[list]:
            found = [sums.predict(t) for t in texts]
            return [ids, [x for x, _ in found], [s for _, s in found], [x != UNKNOWN and s >= sums.model.reject_below for x, s in found]]

        return work

    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), SCHEMA, make)


def remainder(id_col: str) -> Column:
    """The CRC-32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    model = train(docs.where(remainder("doc_id") != 1))
    return identify(docs, model).select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "lang_pred", "score", "accepted")
