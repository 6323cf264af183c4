"""URL filter: memory-mapped sorted 64-bit digests, vectorised binary search, stored strings against collisions.

A rule is a host and the beginning of a path. A url is probed with every suffix of its host that begins at a label and has no more labels than the rules' hosts, nor is longer,
joined to the beginning of its path in every length that some rule has. The keys of all probes are looked up in one vectorised
binary search over the sorted array of the rules' keys; a hit counts only if the string stored
beside the key equals the probe. Of the hits of a url the longest rule wins.

The table is built once on the driver from the rules, checked against ``max_bytes``, and broadcast; each worker process maps it once, from a nameless
file of its own, so it is paged in on demand, no other process needs the file, and nothing stays behind when a worker is lost.
Rule sets beyond the bound go through :func:`judge_by_join` instead, where Spark joins probes and rules by their strings.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_batches
from tenderlake.sources.tables import load_table

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SCHEMA = arrow_fields(page_id="long", host="text", path="text", rule="text", verdict="text")


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.search(url or "")
    return (m[1].translate(ASCII_LOWER), m[2]) if m else ("", "")


class RuleTable:
    """Sorted keys, and the strings and verdicts in the same order, in one block of bytes."""

    #: The table that this process has mapped last, and its digest.
    mapped: tuple[int, RuleTable] | None = None

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, strings: np.ndarray, blocks: np.ndarray, labels: int, longest: int, lengths: list[int]) -> None:
        """``labels`` and ``longest``: the most labels and characters of any rule's host; ``lengths``: of the rules' paths."""
        self.keys, self.offsets, self.strings, self.blocks, self.labels, self.longest, self.lengths = keys, offsets, strings, blocks, labels, longest, lengths

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> RuleTable:
        """Rules (host, path, allow or block); of rules that repeat a host and path one that allows counts, in whatever order they come."""
        seen: dict[bytes, bool] = {}
        for host, path, verdict in rules:
            key = f"{host.translate(ASCII_LOWER)}\0{path}".encode()
            seen[key] = verdict == "block" and seen.get(key, True)
        entries = sorted((xxhash.xxh64_intdigest(s), s, blocked) for s, blocked in seen.items())
        offsets = np.cumsum([0, *(len(s) for _, s, _ in entries)]).astype(np.int64)
        parts = [s.decode().partition("\0") for s in seen]
        lengths = sorted({len(path) for _, _, path in parts})
        labels, longest = max((h.count(".") + 1 for h, _, _ in parts), default=0), max((len(h) for h, _, _ in parts), default=0)
        return RuleTable(np.array([k for k, _, _ in entries], np.uint64), offsets, np.frombuffer(b"".join(s for _, s, _ in entries), np.uint8), np.array([b for _, _, b in entries], np.uint8), labels, longest, lengths)

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.strings), self.labels, self.longest, len(self.lengths), *self.lengths], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.offsets, self.strings, self.blocks))

    @staticmethod
    def map(packed: bytes) -> RuleTable:
        """Map ``packed`` from a nameless file: it has no path that another process could come to rely on, and it goes with its worker."""
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            whole = np.memmap(f, np.uint8, "r", shape=(len(packed),))
        n, size, labels, longest, k = whole[:40].view(np.int64)
        at = 40 + 8 * int(k)
        lengths = whole[40:at].view(np.int64).tolist()
        parts = []
        for width, kind in ((8 * n, np.uint64), (8 * (n + 1), np.int64), (size, np.uint8), (n, np.uint8)):
            parts.append(whole[at : at + int(width)].view(kind))
            at += int(width)
        return RuleTable(*parts, int(labels), int(longest), lengths)

    @classmethod
    def once(cls, digest: int, shared) -> RuleTable:
        """The table behind a broadcast, mapped once for all tasks that this process runs."""
        if cls.mapped is None or cls.mapped[0] != digest:
            cls.mapped = digest, cls.map(shared.value)
        return cls.mapped[1]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe among the rules, -1 if it is none."""
        if not probes or not len(self.keys):
            return np.full(len(probes), -1)
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # rules whose keys collide stand side by side
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def rule(self, j: int) -> tuple[str, str]:
        text = self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes().decode().replace("\0", "")
        return text, "block" if self.blocks[j] else "allow"


def probes_of(host: str, path: str, table: RuleTable) -> list[bytes]:
    """From the longest host to the shortest. However many labels a host has, only as many as some rule's host has are taken off its end."""
    if not host:
        return []
    labels = host.rsplit(".", table.labels)[-table.labels :] if table.labels else []
    suffixes = [s for i in range(len(labels)) if len(s := ".".join(labels[i:])) <= table.longest]
    return [f"{s}\0{path[:n]}".encode("utf-8", "surrogatepass") for s in suffixes for n in table.lengths if n <= len(path)]


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = 256 << 20) -> DataFrame:
    """One row for each row of ``df``: ``page_id, host, path, rule, verdict``.

    The rule is host and path of the longest rule that fits (its host or a subdomain, and the beginning of its path; between
    rules of one length the longer host), null if none does; the verdict is the rule's, else ``default``. A null url, or one without ``://``, has an empty
    host and path and no rule. Rows may repeat; ids may be null; other columns aren't read; an empty table gives an empty result.
    Of rules that repeat a host and path one that allows counts. Hosts and paths of any length take no more probes than the rules' labels and path lengths. A table of rules over ``max_bytes`` is refused: use :func:`judge_by_join`.
    """
    packed = RuleTable.build(rules).pack()
    if len(packed) > max_bytes:
        raise ValueError(f"the rules take {len(packed)} bytes, more than may be broadcast ({max_bytes}); use judge_by_join")
    shared, digest = df.sparkSession.sparkContext.broadcast(packed), xxhash.xxh64_intdigest(packed)

    def run(batches):
        table = RuleTable.once(digest, shared)
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            each = [probes_of(h, p, table) for h, p in parts]
            found = table.find([x for probes in each for x in probes])
            names, verdicts, at = [], [], 0
            for probes in each:
                hits = [table.rule(int(j)) for j in found[at : at + len(probes)] if j >= 0]
                at += len(probes)
                # Probes come from the longest host to the shortest, so of one length the longer host is first.
                name, verdict = max(hits, key=lambda x: len(x[0]), default=(None, default))
                names.append(name)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([ids, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], schema=SCHEMA)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")), SCHEMA, run)


def judge_by_join(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """As :func:`judge_urls`, for a table of ``rules`` (host, path, verdict) of any size: its probes meet the rules in a join by string.

    A url has a probe for each suffix of its host and each length of path that some rule with this host has. Lengths come from a table, not from the driver, so their number
    is free. Of rules that repeat a host and path one that allows counts, as there. Rows that repeat stay as many; null urls and ids, other columns and empty tables as there.
    """
    u = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    form = r"(?s)://([^/?#]*)([^?#]*)"
    pages = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), lower(F.regexp_extract(u, form, 1)).alias("host"), F.regexp_extract(u, form, 2).alias("path"))
    named = rules.groupBy(lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("rule_verdict"))
    lengths = named.select("rule_host", F.length("rule_path").alias("n")).distinct()
    # As many labels as some rule's host has, from a host's end.
    most = named.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    labels = F.split(F.substring_index("host", ".", -most), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # Each host and path once, however many pages have them.
    urls = pages.where("host != ''").select("host", "path").distinct()
    probes = urls.withColumn("rule_host", F.explode(suffixes)).join(lengths, "rule_host").where("n <= length(path)").withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best")
    hits = probes.join(named, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best)
    return pages.join(hits, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load_table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM u JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY ALL
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.rverdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id, host, path)
"""
