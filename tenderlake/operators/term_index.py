"""Many terms looked for in many texts at once: runs of bytes of the texts are looked up among those that the terms are filed under, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
#: By a number of bytes, the bits of a little-endian word that hold them.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    padded = data + bytes(8)
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many parts of each row, its row and its number there."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


class TermIndex:
    """Terms (bytes) with their tags. Each is filed under a run of ``gram`` bytes (8 at most; a shorter term under itself), the one of its runs that the fewest terms have.

    UTF-8 texts hold a term exactly where they hold its bytes.
    """

    def __init__(self, terms: list[bytes], tags: list[str], gram: int = 8) -> None:
        gram = min(gram, 8)
        names = {t: i for i, t in enumerate(dict.fromkeys(tags))}
        numbers = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        self.tags = list(names)
        which = np.array([numbers[t] for t in terms], np.int64)
        codes = np.array([names[t] for t in tags], np.int64)[np.argsort(which, kind="stable")]
        self.n_tags = np.bincount(which, minlength=len(numbers))
        self.tag_codes, self.tag_starts = codes, np.cumsum(self.n_tags) - self.n_tags
        self.data = b"".join(numbers)
        self.lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.zeros(len(numbers), np.int64)
        self.empty = np.flatnonzero(self.lengths == 0)
        sizes = np.minimum(self.lengths, gram)
        words = words_at(self.data)
        self.files = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            rows, place = spread(self.lengths[own] - size + 1)
            runs = words[self.starts[own][rows] + place] & MASKS[size]
            _, same, often = np.unique(runs, return_inverse=True, return_counts=True)
            order = np.lexsort((place, often[same], rows))
            first = order[np.searchsorted(rows[order], np.arange(len(own)))]
            self.at[own] = place[first]
            by_run = np.argsort(runs[first], kind="stable")
            keys, begin, count = np.unique(runs[first][by_run], return_index=True, return_counts=True)
            maybe = np.zeros(1 << BITS, bool)
            maybe[(keys * ODD) >> np.uint64(64 - BITS)] = True
            self.files.append((size, keys, begin, count, own[by_run], maybe))

    def find(self, data: bytes, ends: np.ndarray, window: int = 1 << 20, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """The texts (numbers) and terms that stand in them, each pair once. ``ends`` has the texts' offsets in ``data``, one more than texts; so many places, and hits to verify, are handled at a time."""
        words, found = words_at(data), [np.zeros(0, np.int64)]
        for block in range(0, len(data), window):
            here = words[block : min(block + window, len(data))].copy()
            for size, keys, begin, count, terms, maybe in self.files:
                runs = here & MASKS[size]
                places = np.flatnonzero(maybe[(runs * ODD) >> np.uint64(64 - BITS)])
                key = np.minimum(np.searchsorted(keys, runs[places]), len(keys) - 1)
                hit = keys[key] == runs[places]
                places, key = places[hit] + block, key[hit]
                pieces = np.flatnonzero(np.diff(np.cumsum(count[key]) // most)) + 1
                for p, k in zip(np.split(places, pieces), np.split(key, pieces), strict=True):
                    rows, nth = spread(count[k])
                    term = terms[begin[k][rows] + nth]
                    doc = (np.searchsorted(ends, p, "right") - 1)[rows]
                    start, length = p[rows] - self.at[term], self.lengths[term]
                    live = np.flatnonzero((start >= ends[doc]) & (start + length <= ends[doc + 1]))
                    found.append(self._equal(words, doc[live], start[live], term[live]))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.lengths)), pairs % max(1, len(self.lengths))

    def _equal(self, words: np.ndarray, doc: np.ndarray, start: np.ndarray, term: np.ndarray) -> np.ndarray:
        own, done, at = words_at(self.data), [], 0
        while len(term):
            left = self.lengths[term] - at
            same = (words[start + at] ^ own[self.starts[term] + at]) & MASKS[np.clip(left, 0, 8)] == 0
            ready = same & (left <= 8)
            done.append(np.unique(doc[ready] * len(self.lengths) + term[ready]))
            more = same & ~ready
            doc, start, term, at = doc[more], start[more], term[more], at + 8
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def tag_batches(self, batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
        """From keys and texts (binary, none null), keys and the distinct tags of each text."""
        for batch in batches:
            texts = batch.column(1)
            lengths = np.fromiter((len(x.as_buffer()) for x in texts), np.int64, len(texts))
            doc, term = self.find(b"".join(x.as_buffer() for x in texts), np.append(0, np.cumsum(lengths)), window)
            if len(self.empty):
                doc, term = np.append(doc, np.arange(len(texts))), np.append(term, np.repeat(self.empty, len(texts)))
            rows, nth = spread(self.n_tags[term])
            pairs = np.unique(doc[rows] * max(1, len(self.tags)) + self.tag_codes[self.tag_starts[term][rows] + nth])
            ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(self.tags))).astype(np.int32)
            tags = pa.array(self.tags, pa.string()).take(pa.array(pairs % max(1, len(self.tags))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), tags)], names=["_key", "_hits"])
