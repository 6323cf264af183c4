"""Best-fit packing of documents into token sequences, as a hierarchy of residual rounds.

1. Each task encodes its documents and cuts the long ones; only sizes, places and check sums leave it, written once to the shared folder.
2. Pieces of full length are sequences of their own. The others are dealt by a hash to leaves of about ``leaf_items`` pieces, and
   each leaf packs its own by best fit, largest first. Nearly full bins are done.
3. The underfull bins of ``fan`` neighbouring leaves meet as items of their fill and are packed by best fit again, and so on up the tree. Before each round the
   bins that have no room for even the smallest open one are done: none of them could be joined with any other.
   Where more than ``leaf_items`` bins would meet in a node, they are dealt anew to as many nodes as it takes, so no task grows with the input; those
   rounds go on, with another deal each time, until one node holds all that is open or a round joins nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import SLICE, arrow_fields, map_batches, text_of
from tenderlake.sources.tables import load_table, materialize

SEQUENCE = 2048
END = b"\0\0\0\0"
#: White space before a space: there the text can't be cut without a look at the context.
ODD_SPACE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")
PIECES = arrow_fields(doc_id="long", piece=pa.int32(), start="long", length="long", ids_crc32="long")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes are themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(0x100 + i): b for i, b in enumerate(others)}}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a ``tokenizers`` file whose ids follow the order of its merges, without its added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    to_bytes = lambda word: bytes(letters[c] for c in word)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError(f"{path}: the ids don't follow the merges")
    ranks = {to_bytes(word): i for word, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The file's added tokens: strings that are one id wherever a text holds them, and part the text like its ends do."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: an added token takes in what stands around it")
    return {t["content"]: t["id"] for t in tokens}


class IdBytes:
    """The ids of texts as little-endian 32-bit words. Stretches from space to space are remembered in two generations of up to ``most``: what is
    met again moves to the young one, and when that is full the old one goes."""

    def __init__(self, encode: Callable[[str], list[int]], added: dict[str, int] | None = None, most: int = 80_000) -> None:
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.added = {word: array("I", (i,)).tobytes() for word, i in (added or {}).items()}
        self.borders = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        (self.newline,) = encode("\n")

    def _ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words, each with a space before it. Those without white space are encoded in one call: a line's end between two of them is a token of its own."""
        words = list(dict.fromkeys(words))
        plain = [w for w in words if w.split() == [w]]
        new = {}
        if plain:
            ids = np.array(self.encode(" " + "\n ".join(plain)), "<u4")
            raw = ids.tobytes()
            ends = (4 * np.append(np.flatnonzero(ids == self.newline), len(ids))).tolist()
            start = 0
            for word, end in zip(plain, ends, strict=True):
                new[word] = raw[start:end]
                start = end + 4
        for word in words:
            if word not in new:
                new[word] = self._ids(" " + word)
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        self.young.update((w, x) for w, x in new.items() if len(w) < 64)
        return new

    def of(self, text: str) -> bytes:
        """The ids of ``text``. Added tokens part it."""
        out, at = [], 0
        for m in self.borders.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._stretch(text[at:])]) if out else self._stretch(text)

    def _stretch(self, text: str) -> bytes:
        """A space after other than white space always begins a token, so the text is cut at those."""
        first, *rest = CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")
        if not first and rest:  # the text begins with a space
            first, rest = " " + rest[0], rest[1:]
        out = list(map(self.young.get, rest))
        if None in out:
            missing = [i for i, ids in enumerate(out) if ids is None]
            old = {w: ids for i in missing if (ids := self.old.get(w := rest[i])) is not None}
            self.young.update(old)
            new = old | self._learn([rest[i] for i in missing if rest[i] not in old])
            for i in missing:
                out[i] = new[rest[i]]
        return self._ids(first) + b"".join(out)


def cut(size: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces: the first takes what the others, all full, leave over."""
    n = -(-size // most)
    first = size - (n - 1) * most
    return [(0, first), *((first + i * most, most) for i in range(n - 1))]


def token_pieces(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids. A null text counts as empty and has one piece, the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = IdBytes(encoding(path, pattern).encode_ordinary, added_tokens(path))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                out = []
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = memoryview(memo.of(text) + END)
                    out += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, most))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), PIECES, run)


def best_fit(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: the bin of each item, its place there, and the fill of each bin.

    Bins stand in a list for each rest; a bit for each list that isn't empty makes "the smallest rest that is large enough" one shift.
    """
    bins = np.empty(len(sizes), np.int64)
    places = np.empty(len(sizes), np.int64)
    rests: list[list[int]] = [[] for _ in range(most + 1)]
    fills: list[int] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            rest = size + (above & -above).bit_length() - 1
            b = rests[rest].pop()
            if not rests[rest]:
                mask ^= 1 << rest
        else:
            rest, b = most, len(fills)
            fills.append(0)
        bins[i], places[i] = b, most - rest
        fills[b] = most - rest + size
        if rest > size:
            rests[rest - size].append(b)
            mask |= 1 << (rest - size)
    return bins, places, np.array(fills, np.int64)


def pack(pieces: DataFrame, most: int = SEQUENCE, leaf_items: int = 32768, fan: int = 16, slack: int = 4) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``most``) and for each its ``sequence_id`` and ``offset``.

    A bin with at most ``slack`` free tokens is nearly full. Lengths may tie and rows may repeat: each row is packed by itself; an empty table gives an
    empty result. No task gets more than about ``leaf_items`` items, whatever the size. Jobs run while the result is built.
    """
    columns = pieces.columns
    pieces = materialize(pieces.withColumn("row_id", F.monotonically_increasing_id()), "pack-pieces")
    short = pieces.where(F.col("length") < most)
    leaves = max(1, -(-short.count() // leaf_items))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def leaf(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        bins, places, fills = best_fit(items["length"].to_numpy(), most)
        return items.drop(columns="leaf").assign(bin=(int(key[0]) << 32) + bins, offset=places, fill=fills[bins])

    packed = short.withColumn("leaf", F.pmod(F.xxhash64("row_id"), F.lit(leaves))).groupBy("leaf").applyInPandas(leaf, f"{typed}, bin bigint, offset bigint, fill bigint")
    packed = materialize(packed, "pack-leaves")

    def node(_: tuple, units: pd.DataFrame) -> pd.DataFrame:
        """Rows are leaf bins; those of one ``unit`` move together."""
        heads = units.drop_duplicates("unit").reset_index(drop=True)
        bins, places, fills = best_fit(heads["fill"].to_numpy(), most)
        names = heads["unit"].to_numpy()[np.unique(bins, return_index=True)[1]]
        at = pd.Index(heads["unit"]).get_indexer(units["unit"])
        b = bins[at]
        return units.assign(unit=names[b], base=units["base"].to_numpy() + places[at], fill=fills[b])

    level = "node bigint, bin bigint, unit bigint, fill bigint, base bigint"
    moved = packed.where((F.col("offset") == 0) & (F.col("fill") < most - slack)).select(F.shiftright("bin", 32).alias("node"), "bin", F.col("bin").alias("unit"), "fill", F.lit(0).cast("bigint").alias("base"))
    size = F.count_distinct("unit")
    units, least = moved.agg(size, F.min("fill")).first()
    done = []
    nodes, turn = leaves, 0
    while nodes > 1 and units:
        turn += 1
        room = F.col("fill") <= min(most - slack - 1, most - least)
        if turn > 1:
            done.append(moved.where(~room))
        here = moved.where(room)
        before, needed = here.agg(size, F.ceil(size / leaf_items)).first()
        nodes = -(-nodes // fan)
        if needed <= nodes:
            here = here.withColumn("node", F.floor(F.col("node") / fan))
        else:
            nodes = needed
            here = here.withColumn("node", F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(nodes)))
        moved = materialize(here.groupBy("node").applyInPandas(node, level), "pack-level")
        units, least = moved.agg(size, F.min("fill")).first()
        if units == before and nodes == needed:
            break
    out = packed.select(*columns, F.col("bin"), "offset")
    if turn:
        places = reduce(DataFrame.unionByName, [*done, moved])
        out = out.join(places.select("bin", "unit", "base"), "bin", "left").select(*columns, F.coalesce("unit", "bin").alias("bin"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    full = pieces.where(F.col("length") == most).select(*columns, (-F.col("row_id") - 1).alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    return out.unionByName(full).select(*columns, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Encode, cut and pack: one row for each piece, ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``path`` names a byte-level vocabulary in the format of the ``tokenizers`` library, which must lie at that path on every node, and ``pattern`` the
    expression that cuts text into words. A null text counts as empty; a null id stays null; repeated rows are packed as
    often as they occur; other columns aren't read; an empty table gives an empty result.
    """
    return pack(token_pieces(df, path, pattern, id_col, text_col, options.get("most", SEQUENCE)), **options)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
