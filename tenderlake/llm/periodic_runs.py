"""Periodic runs by grammar compression.

The word ids of a block of documents are compressed by Re-Pair in rounds: pairs of neighbours that occur more than once are counted, and each that is more frequent than
those it overlaps is replaced by a nonterminal, until no pair repeats. What is left of each document, its start rule, is then halved in the same way, so that every document ends
as one symbol. Every nonterminal stands for the concatenation of two others, and a run lies across the boundary of exactly one place of the derivation, the smallest one that holds it whole.

For each nonterminal the runs across its boundary are computed once, on its first place: words at distances of the period from the boundary must agree, which leaves few periods; these are
extended word by word. They are translated to all places of the nonterminal. A run that ends at the border of its nonterminal may go on outside, where a larger one finds it again, so
intervals of one period that overlap are merged, and of equal intervals the smallest period is the run's.

Documents are compressed in blocks of bounded size inside the tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_batches, text_of
from tenderlake.sources.tables import load_table

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = arrow_fields(id="long", n_words="long", runs=RUNS, collapsed="text")
#: Periods that are tried at once, in all nonterminals together.
TRIED_AT_ONCE = 1 << 20


class Crossings:
    """Runs across the boundaries of nonterminals, for a block of words."""

    def __init__(self, words: np.ndarray, least: int, times: int) -> None:
        self.words, self.least, self.times = words, least, times
        self.found: dict[str, list[np.ndarray]] = defaultdict(list)

    def add(self, start: np.ndarray, split: np.ndarray, end: np.ndarray, owner: np.ndarray, places: np.ndarray, place_owner: np.ndarray) -> None:
        """Nonterminals, by their first place ``[start, end)`` and boundary ``split``; ``places`` are the starts of all their places, ``place_owner`` the nonterminals' numbers there."""
        size = end - start
        fit = np.flatnonzero(size >= max(self.least, self.times))
        if not len(fit):
            return
        # A period of q needs ``times`` * q words around the boundary.
        most = size[fit] // self.times
        runs: list[tuple[int, int, int, int]] = []
        done = np.cumsum(most)
        at = 0
        while at < len(fit):
            upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + TRIED_AT_ONCE, "right")))
            part, many = fit[at:upto], most[at:upto]
            # One nonterminal may have more periods than are tried at once: they are cut into stretches.
            for low in range(0, int(many.max()), TRIED_AT_ONCE):
                self._periods(part, np.minimum(many, low + TRIED_AT_ONCE), low, start, split, end, runs)
            at = upto
        if not runs:
            return
        node, s, e, q = np.array(runs, np.int64).T
        # To all places of the nonterminal.
        order = np.argsort(place_owner, kind="stable")
        lo, hi = np.searchsorted(place_owner[order], owner[node]), np.searchsorted(place_owner[order], owner[node], "right")
        times = hi - lo
        which = np.repeat(np.arange(len(node)), times)
        shift = places[order][np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())] - start[node][which]
        for name, values in (("start", s[which] + shift), ("end", e[which] + shift), ("period", q[which])):
            self.found[name].append(values)

    def _periods(self, part: np.ndarray, upto: np.ndarray, low: int, start: np.ndarray, split: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int, int]]) -> None:
        many = np.maximum(upto - low, 0)
        node = np.repeat(part, many)
        q = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low + 1
        w = self.words
        for b in (split, split - 1):
            # Both words at the boundary belong to the run, and so do ``times`` words in a row at distances of q, that one among them.
            at = b[node]
            here = w[at]
            row = np.ones(len(at), np.int64)
            for step in (q, -q):
                going, next_ = np.ones(len(at), bool), at
                for _ in range(self.times - 1):
                    next_ = next_ + step
                    going &= (next_ >= start[node]) & (next_ < end[node])
                    going &= w[np.where(going, next_, at)] == here
                    row += going
                    if not going.any():
                        break
            good = row >= self.times
            node, q = node[good], q[good]
            if not len(q):
                return
        for x, p in zip(node.tolist(), q.tolist(), strict=True):
            a, b, z = int(start[x]), int(split[x]), int(end[x])
            # Word i equals word i + p within the run. Of three periods of such places, one stands at the boundary or a period before it; two runs may meet there.
            for i in (b - p, b - 1):
                if i < a or i + p >= z or w[i] != w[i + p]:
                    continue
                # What a run across this boundary has as a multiple of its period is that run.
                if any(p % r == 0 and s <= i and i + p < e for y, s, e, r in reversed(runs) if y == x):
                    continue
                s, e = self._extend(a, z, i, p)
                if e - s >= max(self.least, self.times * p) and s < b < e:
                    runs.append((x, s, e, p))

    def _extend(self, a: int, z: int, i: int, p: int) -> tuple[int, int]:
        """The longest stretch of period ``p`` within ``[a, z)`` around word ``i``, which equals word ``i + p``."""
        w = self.words
        e, step = i + 1, 64
        while e + p < z:
            upto = min(e + step, z - p)
            differ = np.flatnonzero(w[e:upto] != w[e + p : upto + p])
            if len(differ):
                e += int(differ[0])
                break
            e, step = upto, step * 2
        s, step = i, 64
        while s > a:
            frm = max(s - step, a)
            differ = np.flatnonzero(w[frm:s] != w[frm + p : s + p])
            if len(differ):
                s = frm + int(differ[-1]) + 1
                break
            s, step = frm, step * 2
        return s, e + p


def compress(symbols: np.ndarray, owner: np.ndarray, visit) -> None:
    """Re-Pair a block of documents (``owner``: the document of each symbol, in order), down to one symbol each.

    ``visit(start, split, end, number, places, place_number)`` is called for the new nonterminals of each round.
    """
    start = np.arange(len(symbols))
    end = start + 1
    names = int(symbols.max(initial=-1)) + 1
    # Pairs that may repeat: those that did in the round before, and those with a new symbol.
    live = np.ones(max(len(symbols) - 1, 0), bool)
    while len(symbols) > 1:
        inside = owner[:-1] == owner[1:]
        if not inside.any():
            return
        count = np.zeros(len(inside), np.int64)
        open_ = np.flatnonzero(live & inside)
        if len(open_):
            _, group, often = np.unique(symbols[open_] * np.int64(names) + symbols[open_ + 1], return_inverse=True, return_counts=True)
            count[open_] = often[group]
            # More frequent than both pairs that it overlaps; of equally frequent ones one by lot, so that a
            # chain of them takes few rounds; of equal pairs in a row (aaaa has three of aa) every other one.
            lot = np.random.default_rng(len(often)).permutation(len(often))
            rank = np.zeros(len(inside), np.int64)
            rank[open_] = count[open_] * (len(often) + 1) + lot[group]
            before, after = np.append(-1, rank[:-1]), np.append(rank[1:], -1)
            head = np.maximum.accumulate(np.where(before == rank, 0, np.arange(len(rank))))
            chosen = np.flatnonzero((count > 1) & (before < rank)[head] & ((np.arange(len(rank)) - head) % 2 == 0) & (after <= rank))
            number = rank[chosen]
        if not len(open_) or not len(chosen):
            # No pair repeats. The start rules: every other pair of each document.
            live[:] = False
            head = np.maximum.accumulate(np.where(np.append(True, ~inside), np.arange(len(owner)), 0))
            chosen = np.flatnonzero(inside & ((np.arange(len(owner)) - head)[:-1] % 2 == 0))
            number = chosen
        unique, first, number = np.unique(number, return_index=True, return_inverse=True)
        place, split, stop = start[chosen], end[chosen], end[chosen + 1]
        visit(place[first], split[first], stop[first], np.arange(len(unique)), place, number)
        symbols[chosen] = names + number
        end[chosen] = stop
        names += len(unique)
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        if live.any():
            fresh = np.zeros(len(symbols), bool)
            fresh[chosen] = True
            repeats = np.append(count > 1, False)[keep]
            fresh = fresh[keep]
            live = (repeats | fresh)[:-1] | fresh[1:]
        symbols, owner, start, end = symbols[keep], owner[keep], start[keep], end[keep]
        live = live[: max(len(symbols) - 1, 0)]


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Columns start, end, period of all maximal runs of a block of documents, by start and period. Words are numbers from 0, smaller than 2**31."""
    crossings = Crossings(words, least, times)
    compress(words.astype(np.int64), owner, crossings.add)
    if not crossings.found:
        return np.empty((0, 3), np.int64)
    s, e, q = (np.concatenate(crossings.found[x]) for x in ("start", "end", "period"))
    # Of one period, what lies within another interval is that one's part.
    document = owner[s]
    order = np.lexsort((-e, s, q, document))
    s, e, q, document = s[order], e[order], q[order], document[order]
    fresh = np.append(True, (q[1:] != q[:-1]) | (document[1:] != document[:-1]))
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(e + group * np.int64(len(words) + 1)) - group * np.int64(len(words) + 1)
    # Merge what overlaps by a period at least: both parts have it, so their union has.
    joined = np.append(False, (~fresh[1:]) & (s[1:] + q[1:] <= reach[:-1]))
    head = np.flatnonzero(~joined)
    s, q, e = s[head], q[head], np.maximum.reduceat(e, head)
    # Of equal intervals the smallest period.
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    keep = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1]))
    out = np.stack([s[keep], e[keep], q[keep]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth document (by the check sum of its id) with a part that repeats, as the query defines it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, change=None, block_words: int = 400_000) -> DataFrame:
    """One row for each row of ``df``: ``id, n_words``, its ``runs`` (``start, length, period``, by start, then period) and the text without repetitions, ``collapsed``.

    Words are what stands between ASCII blanks. A run is a stretch of words with smallest period q, of ``least`` words and ``times`` periods at least, that no neighbouring word continues. Of each run
    the words behind the first period are dropped, once where runs overlap; the rest is joined by single blanks. ``change(words, id)`` may change a document's words first.

    A null text counts as empty and has no runs. Null ids stay null, rows that repeat are done each by itself, an empty table gives an empty result; other columns aren't read, whatever
    their names. A document is never cut: a block holds whole documents, ``block_words`` words or one document that is longer.
    """

    def block_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        found = find_runs(words, owner, least, times)
        per = np.split(found, np.searchsorted(found[:, 0], first[1:])) if len(texts) else []
        runs, collapsed = [], []
        for t, at, mine in zip(texts, first.tolist(), per, strict=True):
            runs.append([{"start": s - at, "length": e - s, "period": q} for s, e, q in mine.tolist()])
            if len(mine):
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, mine[:, 0] - at + mine[:, 2], 1)
                np.add.at(edge, mine[:, 1] - at, -1)
                t = [w for w, over in zip(t, np.cumsum(edge[:-1]).tolist(), strict=True) if not over]
            collapsed.append(b" ".join(t).decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(runs, RUNS), pa.array(collapsed, pa.string())], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Of bytes, split() knows the ASCII blanks only.
                words = text.encode().split()
                ids.append(doc)
                texts.append(change(words, doc) if change else words)
                held += len(words)
                if held >= block_words:
                    yield block_of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield block_of(ids, texts)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), FOUND, run)


def report_runs(collapsed: DataFrame) -> DataFrame:
    """From :func:`collapse_runs`: the number of runs, the longest one (the first of equal ones, of these the shortest period), and digests of all runs and of the text that is left."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    return collapsed.withColumn("_best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.shortness")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-F.col("_best.shortness") * 1000 / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_runs(collapse_runs(load_table(spark, sf_dir, "documents"), change=periodic))
