"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if every token encodes to itself and every two neighbours are the encoding
of the two joined: merges run inside a token as they would without its surroundings, and the first one across a border would show in that pair
alone. So the merges compile into a nondeterministic machine. Its places are pairs (kind of the token before, node of the vocabulary's byte trie);
a byte moves along the trie, and where a token ends and agrees with the one before it, the place also steps to the root with that
token as the one before. Tokens are of one kind if their right ends take part in the same merges, so that none of the
tokens behind can tell them apart; most long tokens are of the one kind that merges with nothing.

The transducer determinises this on demand. A state holds all places that the bytes so far allow. Every beginning of the bytes has one
encoding, so on each arc exactly one token ends in agreement, and that is the arc's output: the last token of the bytes up to there. Going back from
token to token gives all of them. The tokens that all places of a state share are certain and are emitted; no place is further behind than the longest
token, and the lookahead of such merges is known to be bounded. States and arcs are kept; when they are ``most``, those not met since the last clearing go, and the youngest if over half are left.

Decoding runs a machine over bytes whose states are the unfinished characters. For each state and token its moves are worked out once and kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_rows, text_of
from tenderlake.sources.tables import load_table

#: Later than any merge.
NEVER = 1 << 60
#: Bits of a trie's node within a place, and of a token within an arc.
NODE, TOKEN = 24, 20
LAST = (1 << TOKEN) - 1


class Merges:
    """Ranked tokens, where a token comes later than its parts, as training leaves them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        # The first merge that takes a token as its left part, or as its right one.
        self.as_left: dict[bytes, int] = {}
        self.as_right: dict[bytes, int] = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = word[:i], word[i:]
                if a in ranks and b in ranks:
                    if rank < self.as_left.get(a, NEVER):
                        self.as_left[a] = rank
                    if rank < self.as_right.get(b, NEVER):
                        self.as_right[b] = rank
        # Kind 0 merges with nothing to its right; it is also what stands before the first token.
        self.kinds: list[tuple[tuple[bytes, int], ...]] = [()]
        self.kind_numbers: dict[tuple[tuple[bytes, int], ...], int] = {(): 0}
        self.kind_of: dict[int, int] = {}
        self.begins: dict[int, list[tuple[bytes, int]] | None] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merge the pair of lowest rank, leftmost first, while there is one and more than ``down_to`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > down_to:
            rank, at = min((get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token's last merge; None if merging its bytes doesn't lead to it."""
        if token not in self.parts:
            parts = self.merge(token, 2)
            self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.parts[token]

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """What stands at the token's left or right end while it is built, from the whole down to a byte, and the rank of the merge that takes it up."""
        out, until = [(token, NEVER)], token
        while len(until) > 1:
            until, rank = self.halves(until)[right], self.ranks[until]
            out.append((until, rank))
        return out

    def kind(self, token: int) -> int:
        """The number of the token's kind: its right ends, those left out that are taken up before any merge to the right could have them."""
        known = self.kind_of.get(token)
        if known is None:
            get = self.as_left.get
            ends = tuple((a, gone) for a, gone in self.edge(self.tokens[token], True) if get(a, NEVER) < gone)
            known = self.kind_numbers.get(ends)
            if known is None:
                known = self.kind_numbers[ends] = len(self.kinds)
                self.kinds.append(ends)
            self.kind_of[token] = known
        return known

    def beginnings(self, token: int) -> list[tuple[bytes, int]] | None:
        """The token's left ends that some merge to the left could have; None if the token doesn't encode to itself."""
        if token not in self.begins:
            word, get = self.tokens[token], self.as_right.get
            good = len(word) == 1 or self.halves(word) is not None
            self.begins[token] = [(b, gone) for b, gone in self.edge(word, False) if get(b, NEVER) <= gone] if good else None
        return self.begins[token]

    def agree(self, kind: int, token: int) -> bool:
        """Whether the token stands behind one of this kind in some encoding.

        It doesn't if some end of the first and some beginning of the second merge before either is taken up by its own token; at one rank
        the pair on the left goes first.
        """
        key = kind << TOKEN | token
        known = self.pairs.get(key)
        if known is None:
            firsts, get = self.beginnings(token), self.ranks.get
            known = firsts is not None
            if firsts:
                for a, a_gone in self.kinds[kind]:
                    for b, b_gone in firsts:
                        rank = get(a + b, NEVER)
                        if rank < a_gone and rank <= b_gone:
                            known = False
                            break
                    if not known:
                        break
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most: int = 200_000) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        if max(ranks.values()) >= 1 << TOKEN:
            raise ValueError(f"ids must be below {1 << TOKEN}")
        self.merges = Merges(ranks)
        self.most = most
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.lengths[i] = len(word)
        # The trie: its arcs by byte, then node, the token that ends at a node, how deep it is, and which nodes lead on.
        self.arcs: list[dict[int, int]] = [{} for _ in range(256)]
        self.ends: list[int] = [-1]
        self.depths: list[int] = [0]
        self.inner: set[int] = set()
        for word, i in ranks.items():
            node = 0
            for b in word:
                arcs = self.arcs[b]
                if node not in arcs:
                    arcs[node] = len(self.ends)
                    self.ends.append(-1)
                    self.depths.append(self.depths[node] + 1)
                    self.inner.add(node)
                node = arcs[node]
            self.ends[node] = i
        self.states: list[tuple[int, ...]] = []
        self.steps: dict[int, int] = {}
        self.numbers: dict[tuple[int, ...], int] = {}
        self.met: set[int] = set()
        self.number((0,))

    def number(self, places: tuple[int, ...]) -> int:
        known = self.numbers.get(places)
        if known is None:
            known = self.numbers[places] = len(self.states)
            self.states.append(places)
        return known

    def clear(self) -> None:
        """If states are ``most``, drop those, and their arcs, that haven't been met since the last clearing. Of those met the older half of ``most`` stays: common states are found first, and to find them again takes most of the time."""
        if len(self.states) <= self.most:
            return
        kept = sorted(self.met | {0})[: max(1, self.most // 2)]
        new = {old: i for i, old in enumerate(kept)}
        self.steps = {new[k >> 8] << 8 | k & 255: new[v >> TOKEN] << TOKEN | v & LAST for k, v in self.steps.items() if k >> 8 in new and v >> TOKEN in new}
        self.states = [self.states[i] for i in kept]
        self.numbers = {places: i for i, places in enumerate(self.states)}
        self.met = set()

    def step(self, state: int, byte: int) -> int:
        """Determinise one arc: the next state, and the last token of the bytes up to there. Places stand in the order in which their tokens began."""
        follow, ends, inner, merges = self.arcs[byte].get, self.ends, self.inner, self.merges
        after, token, low = [], -1, (1 << NODE) - 1
        for place in self.states[state]:
            at = place & low
            node = follow(at)
            if node is None:
                continue
            if node in inner:
                after.append(place - at + node)
            if token < 0 and (end := ends[node]) >= 0 and merges.agree(place >> NODE, end):
                token = end
        after.append(self.merges.kind(token) << NODE)
        arc = self.steps[state << 8 | byte] = self.number(tuple(after)) << TOKEN | token
        return arc

    def arc(self, key: int) -> int:
        return self.steps.get(key) or self.step(key >> 8, key & 255)

    def encode(self, data: bytes, block: int = 1 << 14) -> list[int]:
        """The ids of the bytes. After each block what is certain is emitted, so a very long word needs no more room than a block."""
        state, out, last = 0, [], []
        for at in range(0, len(data), block):
            places = self.states[state]
            self.clear()
            state = self.number(places)
            for byte in data[at : at + block]:
                arc = self.arc(state << 8 | byte)
                state = arc >> TOKEN
                self.met.add(state)
                last.append(arc & LAST)
            if at + block < len(data):
                certain = self.shared(last, self.states[state])
                out += self.back(last, certain)
                del last[:certain]
        return out + self.back(last, len(last))

    def shared(self, last: list[int], places: tuple[int, ...]) -> int:
        """The end of the tokens that all places share: whichever reaches furthest goes back a token, until all stand at one byte."""
        ends = {len(last) - self.depths[place & (1 << NODE) - 1] for place in places}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - int(self.lengths[last[end - 1]]))
        return ends.pop()

    def back(self, last: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes, from the last one's token on back."""
        out = []
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= int(self.lengths[token])
        out.reverse()
        return out

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one behind the other, and how many each has. All words take a step at a time together; each arc is looked up once a step."""
        self.clear()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.frombuffer(b"".join(map(words.__getitem__, order.tolist())), np.uint8)
        starts = np.cumsum(sizes) - sizes
        last = np.empty(len(data), np.int64)
        states = np.zeros(len(words), np.int64)
        for p in range(int(sizes[0]) if len(sizes) else 0):
            going = int(np.searchsorted(-sizes, -p))  # words stand from the longest to the shortest
            at = starts[:going] + p
            keys, place = np.unique(states[:going] << 8 | data[at], return_inverse=True)
            found = list(map(self.steps.get, keys.tolist()))
            if None in found:
                found = [self.step(key >> 8, key & 255) if arc is None else arc for key, arc in zip(keys.tolist(), found, strict=True)]
            arcs = np.array(found, np.int64)
            self.met.update((arcs >> TOKEN).tolist())
            arcs = arcs[place]
            states[:going] = arcs >> TOKEN
            last[at] = arcs & LAST
        # Back from the ends, all words together again.
        left, going, rounds = sizes.copy(), np.flatnonzero(sizes), []
        counts = np.zeros(len(words), np.int64)
        while len(going):
            token = last[starts[going] + left[going] - 1]
            rounds.append((going, token))
            counts[going] += 1
            left[going] -= self.lengths[token]
            going = going[left[going] > 0]
        by_word = np.empty(len(words), np.int64)
        by_word[order] = counts
        ends = np.cumsum(by_word)[order]
        ids = np.empty(int(by_word.sum()), np.uint32)
        for i, (which, token) in enumerate(rounds):
            ids[ends[which] - 1 - i] = token
        return ids, by_word


def followers(lead: int) -> tuple[int, int, int]:
    """How many bytes follow a lead byte, and the least and the greatest that may come first; 0 of them if it leads no character of several bytes.

    Fixed values of the UTF-8 standard: the narrower limits keep out overlong forms, surrogates and what lies beyond U+10FFFF.
    """
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return 0, 0, 0


class Utf8Machine:
    """Bytes to text. A state is an unfinished character: what is still to come, the limits of the next byte, and the bits so far.

    What can't go on is one replacement character, and the byte that broke it begins anew.
    """

    START = (0, 0, 0, 0)
    #: Tokens that are looked up together.
    STRETCH = 64

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        #: By state, then token: the next state's table and the text.
        self.tables: dict[tuple[int, int, int, int], dict] = {}
        start = self.table(self.START)

        class Whole(dict):
            def __missing__(self, token: int) -> str:
                after, text = start[token]
                if after is not start:
                    raise KeyError(token)
                self[token] = text
                return text

        #: The text of each token that is whole characters by itself.
        self.whole = Whole()

    @classmethod
    def move(cls, state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
        left, low, high, bits = state
        before = ""
        if left:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                return (cls.START, chr(bits)) if left == 1 else ((left - 1, 0x80, 0xBF, bits), "")
            before = "\ufffd"
        if byte < 0x80:
            return cls.START, before + chr(byte)
        left, low, high = followers(byte)
        if not left:
            return cls.START, before + "\ufffd"
        return (left, low, high, byte & (0x3F >> left)), before

    def table(self, state: tuple[int, int, int, int]) -> dict:
        """The moves from a state, worked out for each token when it is first met there."""
        if state not in self.tables:
            machine = self

            class Moves(dict):
                def __missing__(self, token: int) -> tuple[dict, str]:
                    now, out = state, []
                    for byte in machine.tokens[token]:
                        now, text = machine.move(now, byte)
                        out.append(text)
                    self[token] = found = (machine.table(now), "".join(out))
                    return found

            self.tables[state] = Moves()
            self.tables[state].unfinished = state != self.START
        return self.tables[state]

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text of the ids, a block at a time. Where no character is unfinished, stretches of tokens that are whole characters are looked up together."""
        start = table = self.table(self.START)
        whole, ids, out, held = self.whole.__getitem__, iter(ids), [], 0
        while part := list(islice(ids, self.STRETCH)):
            try:
                if table is not start:
                    raise KeyError
                out.extend(map(whole, part))
            except KeyError:
                del out[held:]
                for i in part:
                    table, text = table[i]
                    out.append(text)
            held = len(out)
            if held >= block:
                yield "".join(out)
                out.clear()
                held = 0
        if table.unfinished:
            out.append("\ufffd")
        yield "".join(out)


class Codec:
    """Encodes each match of the pattern by itself; a match that is a token as a whole is that token, as in the public library."""

    #: White space before a space: elsewhere a space always begins a match, so the text can be cut before it.
    ODD_SPACE = re.compile(r"\s ")
    CUT = re.compile(r"(?<=\S)(?= )")
    #: Matches of up to so many bytes take their steps together.
    SHORT = 256

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 200_000) -> None:
        self.transducer = Transducer(ranks)
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.machine = Utf8Machine(self.transducer.merges.tokens)
        self.most = most
        # Ids of stretches from space to space and of the matches in them. Two generations: what is met again moves to the young one; when that is full, the old one goes.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        if self.ODD_SPACE.search(text):
            return self.CUT.split(text)
        first, *rest = text.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest

    def _unknown(self, strings: Iterable[str]) -> list[str]:
        """Those of the strings that no memo has; what the old one has moves to the young one."""
        young, old = self.young, self.old
        missing = [x for x in strings if x not in young]
        out = []
        for x in missing:
            ids = old.get(x)
            if ids is None:
                out.append(x)
            else:
                young[x] = ids
        return out

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """The ids of matches, as 32-bit words."""
        new = {}
        short = []
        get = self.ranks.get
        for m in matches:
            word = m.encode()
            token = get(word)
            if token is not None:
                new[m] = token.to_bytes(4, sys.byteorder)
            elif len(word) > self.SHORT:
                new[m] = array("I", self.transducer.encode(word)).tobytes()
            else:
                short.append((m, word))
        ids, counts = self.transducer.encode_all([w for _, w in short])
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        for (m, _), start, end in zip(short, [0, *ends], ends, strict=False):
            new[m] = raw[start:end]
        return new

    def _split(self, parts: list[str]) -> list[tuple[str, list[str]]]:
        """Each stretch with its matches. Those of a space and what isn't white space are cut in one go: a line's end between two is a match of its own."""
        plain, groups = [], []
        for p in parts:
            if p[0] == " " and p[1:].split() == [p[1:]]:
                plain.append(p)
            else:
                groups.append((p, self.pattern.findall(p)))
        found = self.pattern.findall("\n".join(plain))
        start = 0
        for p in plain:
            end, size = start, 0
            while size < len(p):
                size += len(found[end])
                end += 1
            groups.append((p, found[start:end]))
            start = end + 1
        return groups

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit numbers."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        cut = [self._parts(text) for text in texts]
        distinct: set[str] = set().union(*cut)
        distinct.discard("")
        # A word of Latin letters, with or without its space, is one match; the rest is left to the pattern.
        single, other = [], []
        for p in self._unknown(distinct):
            (single if (p[1:] if p[0] == " " else p).isalpha() and max(p) < "\u0250" else other).append(p)
        groups = self._split(other)
        within = {m for _, found in groups for m in found}.difference(single)
        new = self._learn(single + self._unknown(within))
        young = self.young
        young.update(new)
        young.update((p, young[found[0]] if len(found) == 1 else b"".join(map(young.__getitem__, found))) for p, found in groups)
        young[""] = b""
        out = [np.frombuffer(b"".join(map(young.__getitem__, parts)), np.uint32) for parts in cut]
        # Long ones aren't worth their room.
        for p in [x for x in (*new, *(p for p, _ in groups)) if len(x) >= 64]:
            young.pop(p, None)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text of the ids, a block at a time."""
        return self.machine.decode(ids, block)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file with a line ``base64 rank`` for each token; one for each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return Codec(ranks, pattern)


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` for each row of ``df``, texts read whole.

    ``path`` must lie on every node. A null text counts as empty and has no ids; a null id stays null; repeated rows repeat; other columns aren't read, whatever
    their names; an empty table gives an empty result.
    """
    schema = arrow_fields(doc_id="long", ids=pa.list_(pa.int32()))
    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), schema, lambda: lambda ids, texts: [ids, codec(path, pattern).encode_all(texts)])


def bpe_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` for each row of ``df``; null ids count as none; cases else as in :func:`bpe_encode`."""
    schema = arrow_fields(doc_id="long", text="text")
    ids = F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>"))
    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), ids), schema, lambda: lambda docs, rows: [docs, ["".join(codec(path, pattern).decode(x)) for x in rows]])


def bpe_round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, so that ids don't leave their task. Cases as in :func:`bpe_encode`."""
    schema = arrow_fields(doc_id="long", n_tokens="long", ids_sha256="text", decoded_sha256="text")

    def make():
        own = codec(path, pattern)

        class Written(dict):
            def __missing__(self, i: int) -> str:
                self[i] = found = str(i)
                return found

        name = Written().__getitem__

        def work(docs: list, texts: list[str]) -> list[list]:
            n, digests, decoded = [], [], []
            for ids in map(np.ndarray.tolist, own.encode_all(texts)):
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for piece in own.decode(ids):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
            return [docs, n, digests, decoded]

        return work

    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), schema, make, 512)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(load_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
