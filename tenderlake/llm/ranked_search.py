"""Ranked search by best-first intervals of documents over range-maximum tables.

Every document is reduced once to a vector of its terms that some query has, and the vectors are written. From them come the statistics: the number of documents and of terms, and in how many
documents each term stands. Then each task turns its vectors into blocks. A block has a posting list for each term, in the order of its documents, with the
impact of the term there, which is what the document's score gets from it; a sparse table over each list answers which posting of any stretch has the largest impact.

A query is searched best first. The sum of its terms' largest impacts within an interval of documents bounds every score there. The interval of the largest bound is taken up: the document with
the largest single impact in it is scored, and what lies before and behind it become two intervals with bounds of their own. Short intervals are scored as a whole. The search of a block
ends when no bound reaches the score of the last document of the best list, which a task carries on from block to block. The best lists of all tasks are merged at last.

No postings are shuffled: a block lives in the task that reads its vectors, and each task gives at most ``k`` rows for a query.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_batches, text_of
from tenderlake.sources.tables import load_table, materialize

#: Of lower-cased UTF-8: letters and digits of ASCII, and whatever lies beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NUMBERS = pa.list_(pa.int32())
VECTORS = arrow_fields(id="long", n="long", terms=NUMBERS, times=NUMBERS)
FOUND = arrow_fields(query=pa.int32(), score="long", id="long")
#: A block ends with so many documents or postings; shorter intervals than LEAF are scored as a whole.
BLOCK_DOCUMENTS, BLOCK_POSTINGS, LEAF = 8192, 500_000, 128
#: Of an id that is null, in order behind all others.
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def term_vectors(df: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", slice_terms: int = 200_000) -> DataFrame:
    """``id, n, terms, times``: for each row the number of all its terms with repeats, and those of the vocabulary, with how often they occur."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def batch_of(ids: list, texts: list[list[bytes]], get) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers = np.fromiter(map(get, (w for t in texts for w in t), repeat(-1)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        known = numbers >= 0
        key, times = np.unique(owner[known] << 32 | numbers[known], return_counts=True)
        ends = pa.array(np.append(0, np.searchsorted(key >> 32, np.arange(len(texts)), "right")).astype(np.int32))
        lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, times))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), *lists], schema=VECTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(TERM.findall(text.encode().lower()))
                held += len(texts[-1])
                if held >= slice_terms:
                    yield batch_of(ids, texts, get)
                    ids, texts, held = [], [], 0
            if ids:
                yield batch_of(ids, texts, get)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), VECTORS, run)


class Block:
    """Posting lists of some documents, one behind the other in one array, with a sparse table of where the largest impact of each stretch of 2**level postings is."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, owner: np.ndarray, impact: np.ndarray) -> None:
        # Documents in order of id, so that of equal scores the one before is the better.
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.width = ids[order], len(ids) + 1
        key = terms.astype(np.int64) * self.width + place[owner]
        by_key = np.argsort(key, kind="stable")
        self.key, self.impact = key[by_key], impact[by_key]
        longest = int(np.bincount(terms).max()) if len(terms) else 1
        self.table = np.zeros((longest.bit_length(), len(key)), np.int32)
        self.table[0] = np.arange(len(key))
        for level in range(1, len(self.table)):
            step = 1 << (level - 1)
            left, right = self.table[level - 1, :-step], self.table[level - 1, step:]
            self.table[level, :-step] = np.where(self.impact[left] >= self.impact[right], left, right)

    def best_postings(self, terms: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each term that has postings in ``[low, high)``: the first and the end of them, and where the largest impact is."""
        first = np.searchsorted(self.key, terms * self.width + low)
        end = np.searchsorted(self.key, terms * self.width + high)
        some = end > first
        first, end = first[some], end[some]
        level = np.frexp((end - first).astype(np.float64))[1] - 1
        a, b = self.table[level, first], self.table[level, end - (1 << level)]
        return first, end, np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, terms: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Bring ``best``, a heap of up to ``k`` (score, id with its sign turned), up to date with this block."""
        n = self.width - 1
        first, end, at = self.best_postings(terms, 0, n)
        if not len(at):
            return
        queue = [(-int(self.impact[at].sum()), 0, n, first, end, at)]

        def offer(score: int, doc: int) -> None:
            entry = (score, -int(self.ids[doc]))
            if score > 0 and (len(best) < k or entry > best[0]):
                heapq.heappush(best, entry) if len(best) < k else heapq.heapreplace(best, entry)

        while queue:
            bound, low, high, first, end, at = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                return
            if high - low <= LEAF:
                sizes = end - first
                place = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
                scores = np.zeros(high - low, np.int64)
                np.add.at(scores, self.key[place] % self.width - low, self.impact[place])
                worth = np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1))
                for doc in worth.tolist():
                    offer(int(scores[doc]), low + doc)
                continue
            top = at[np.argmax(self.impact[at])]
            doc = int(self.key[top] % self.width)
            # Its score: the impacts of the terms that it has.
            mine = terms * self.width + doc
            where = np.minimum(np.searchsorted(self.key, mine), len(self.key) - 1)
            offer(int(self.impact[where[self.key[where] == mine]].sum()), doc)
            for a, b in ((low, doc), (doc + 1, high)):
                first, end, at = self.best_postings(terms, a, b)
                if len(at):
                    bound = int(self.impact[at].sum())
                    if len(best) < k or bound >= best[0][0]:
                        heapq.heappush(queue, (-bound, a, b, first, end, at))


def search_blocks(vectors: DataFrame, queries: list[list[int]], documents: int, terms: int, frequency: dict[int, int], k: int) -> DataFrame:
    """``query, score, id``: for each task and query the best ``k`` documents of the task's vectors."""
    size = max(frequency, default=-1) + 1
    weight = np.zeros(size, np.int64)
    for term, df in frequency.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    # Terms that no document has are looked up in vain.
    asked = [np.array([t for t in q if t in frequency], np.int64) for q in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((weight, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not part.num_rows:
                return
            lists = part.column("terms").combine_chunks()
            t, tf = (part.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            n = part.column("n").to_numpy()
            m = 10 + (90 * n * documents) // max(terms, 1)
            impact = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            block = Block(part.column("id").combine_chunks().fill_null(NO_ID).to_numpy(), t, owner, impact)
            for q, heap in zip(asked, best, strict=True):
                if len(q):
                    block.search(q, k, heap)

        postings = rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                held.append(piece)
                rows += piece.num_rows
                postings += len(piece.column(2).flatten())
                if rows >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                    finish()
                    postings = rows = 0
        if held:
            finish()
        out = [(i, score, -doc if -doc != NO_ID else None) for i, heap in enumerate(best) for score, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else ([], [], []), FOUND, strict=True)], schema=FOUND)

    return map_batches(vectors, FOUND, run)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", group_chars: int = 16 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's ``k`` best documents with a score above 0, equal scores by ascending id.

    Queries are the small side: they are read in groups of up to ``group_chars`` characters, whose terms are broadcast, and each group is answered by all documents. Terms, weights and
    scores are those of the query's contract. A null text has no terms, so a null document isn't counted and a null query finds nothing. A null id of a document comes behind all others of equal score;
    rows that repeat an id are documents or queries of their own; of rows that agree in score and id either comes first. Empty tables give an empty result; other columns aren't read, whatever
    their names. Very long texts are read whole. Jobs run while the result is built: one that writes the term vectors, and two that count.
    """
    spark = docs.sparkSession
    out: DataFrame | None = None
    for ids, texts in _groups(queries.select(F.col(f"`{query_id}`").cast("bigint"), text_of(query_text)), group_chars):
        vocabulary: dict[bytes, int] = {}
        asked = [sorted({vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(t)}) for t in texts]
        vectors = materialize(term_vectors(docs, vocabulary, doc_id, doc_text), "term-vectors")
        documents, terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        found = search_blocks(vectors, asked, documents, terms, frequency, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "query int, item_id bigint"))
        part = ranked.join(names, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def _groups(queries: DataFrame, chars: int) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    held = 0
    for i, text in queries.toLocalIterator():
        ids.append(i)
        texts.append(text)
        held += len(text) + 1
        if held >= chars:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
