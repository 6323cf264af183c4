"""Secret scan: fixed patterns, plus sliding-window Shannon entropy per character class.

A candidate is a maximal run of the characters that keys are made of, at least ``window`` long. Over it slides a window of
``window`` characters; the counts of its characters, and with them the sum of ``c * log2(c)``, change by one character
in and one out at each step, so the entropy of every window costs constant time. So do the counts of the characters outside each class, and they tell the narrowest
class that holds the whole window. Each class has a threshold of its own: a window of digits can hold 3.3 bits a character at most, one of hexadecimal
digits 4, and one of 16 different characters 4 as well. Windows over the threshold of their class join into a span, unless the allow-list knows the candidate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_rows, text_of
from tenderlake.sources.tables import load_table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: The patterns' bases, ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+``, take whole runs; so the lengths can stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")


@dataclass(frozen=True)
class EntropyRules:
    """``window`` characters a window; thresholds in bits a character for each class; patterns of runs to leave alone."""

    window: int = 16
    #: From the narrowest class to the widest.
    classes: tuple[tuple[str, str, float], ...] = (
        ("digits", "0123456789", 2.9),
        ("hex", "0123456789abcdefABCDEF", 3.0),
        ("alnum", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
        ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7),
    )
    #: Possessive throughout: a long run is read once.
    allow: tuple[str, ...] = (
        r"(?:[A-Z]?[a-z]++|[A-Z]++)(?:[-_/+=]++(?:[A-Z]?[a-z]++|[A-Z]++))*+[-_/+=]*+",  # words of one case, also joined to a slug or a path
        r"(?:[A-Z]?[a-z]{3,}+)++[0-9]{0,4}+",  # words run together by capitals
        r"[A-Za-z]*+[0-9]{0,4}+(?:[-_/+=]++(?:[A-Z]?[a-z]++|[A-Z]++)?+[0-9]{0,4}+)++",  # words with small numbers
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # a UUID
        r"[-_/+=]*+(.)\1++[-_/+=]*+",  # a rule or filler
        r"[0-9]{1,24}+",  # a number
        r"[0-9]{1,8}+(?:[-_/=+][0-9]{1,8}+)++",  # dates and groups of digits
    )


class Window:
    """Entropy in bits a character and the narrowest class of each window, by incremental counts."""

    def __init__(self, rules: EntropyRules) -> None:
        self.size = rules.window
        # A character comes in before one goes out.
        self.weight = [0.0, 0.0, *(c * math.log2(c) for c in range(2, rules.window + 2))]
        # For each character, how many of the classes, from the narrowest on, it is outside of.
        self.outside = {c: next(i for i, (_, chars, _) in enumerate(rules.classes) if c in chars) for c in rules.classes[-1][1]}
        self.n = len(rules.classes)

    def slide(self, text: str) -> Iterator[tuple[float, int]]:
        """(entropy, number of the class) for each window of ``text``."""
        size, weight, outside = self.size, self.weight, self.outside
        counts: dict[str, int] = {}
        levels = [0] * self.n
        total = 0.0
        for i, new in enumerate(text):
            c = counts.get(new, 0)
            counts[new] = c + 1
            total += weight[c + 1] - weight[c]
            levels[outside[new]] += 1
            if i >= size:
                old = text[i - size]
                c = counts[old]
                counts[old] = c - 1
                total += weight[c - 1] - weight[c]
                levels[outside[old]] -= 1
            if i >= size - 1:
                yield math.log2(size) - total / size, max(k for k, n in enumerate(levels) if n)


class EntropyScanner:
    def __init__(self, rules: EntropyRules) -> None:
        self.window = Window(rules)
        self.run = re.compile(f"[{re.escape(rules.classes[-1][1])}]{{{rules.window},}}")
        self.allow = [re.compile(x) for x in rules.allow]
        self.limits = [limit for _, _, limit in rules.classes]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for run in self.run.finditer(text):
            value = run[0]
            if any(x.fullmatch(value) for x in self.allow):
                continue
            start = end = None
            for i, (bits, kind) in enumerate(self.window.slide(value)):
                if bits >= self.limits[kind]:
                    if end is not None and i > end:
                        out.append((run.start() + start, run.start() + end))
                        start = None
                    start, end = (i if start is None else start), i + self.window.size
            if start is not None:
                out.append((run.start() + start, run.start() + end))
        return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind, those that fail a length dropped."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def scan_text(text: str, scanner: EntropyScanner) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans, each by start, then kind. An entropy span within a base span says nothing new and is left out."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=order)
    extra, at, reach = [], 0, -1
    for s, e in scanner.spans(text):
        # How far the base spans reach that begin up to here.
        while at < len(base) and base[at][1] <= s:
            reach = max(reach, base[at][2])
            at += 1
        if e > reach:
            extra.append(("entropy", s, e))
    return base, sorted(base + extra, key=order)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())])
SCHEMA = arrow_fields(doc_id="long", spans=pa.list_(SPAN))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules | None = None) -> DataFrame:
    """One row for each row of ``df``: ``doc_id`` and the ``spans`` (kind, start, end in code points, text, whether a base pattern gave it).

    A null text counts as empty and has no spans; a null id stays null; repeated rows give repeated results; other columns
    of ``df`` are not read, whatever their names; an empty table gives an empty result. Texts are read whole.
    """
    rules = rules or EntropyRules()

    def make():
        scanner = EntropyScanner(rules)

        def work(ids: list, texts: list[str]) -> list[list]:
            out = []
            for text in texts:
                base, spans = scan_text(text, scanner)
                held = set(base)
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "base": (k, s, e) in held} for k, s, e in spans])
            return [ids, out]

        return work

    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), SCHEMA, make)


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules: EntropyRules | None = None) -> DataFrame:
    """``df`` with every span of every text replaced by ``mask`` (overlapping spans by one).

    Whole texts are masked; null and empty texts stay as they are; ids aren't read, so null and repeated ones stay; all other columns stay, whatever
    their names; an empty table gives an empty result.
    """
    rules = rules or EntropyRules()
    columns = df.columns
    at = columns.index(text_col)

    def clean(text: str | None, scanner: EntropyScanner) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for _, start, end in scan_text(text, scanner)[1]:
            if start >= done:
                out += [text[done:start], mask]
            done = max(done, end)
        return "".join([*out, text[done:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        scanner = EntropyScanner(rules)
        return texts.map(lambda x: clean(x, scanner))

    return df.select(*(cleaned(F.col(f"`{c}`")).alias(c) if i == at else F.col(f"`{c}`") for i, c in enumerate(columns)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    put = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(put(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), put(F.col("spans")).alias("spans"))
