"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32. If two fingerprints differ in fewer than six bits, then
in some segment they differ in two at most, and some value lies within one bit of both. So each fingerprint enumerates the ball of radius one
around each of its segments (33 values) and is filed in the table under each; fingerprints that meet in an entry are compared in full.

* Only distinct fingerprints take part, so copies cost one row.
* An entry with up to ``bucket`` fingerprints is compared inside one task. It gives not its pairs but a spanning forest of its links: at most one edge a row.
* Larger entries (dense families of near copies) go another way, also whole: each of their fingerprints is filed under every value within two bits of it (2,081).
  Fingerprints filed together differ by four bits at most, and any two that do meet somewhere: so each such entry is one star of links, without
  comparisons, and has 2,081 members at most.

The links then go to a distributed search for connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import SEED, SLICE, arrow_fields, join_split, map_batches, shingles, text_of
from tenderlake.llm.components import connected_components, named_components
from tenderlake.sources.tables import load_table, materialize

SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Fingerprints link at so many differing bits.
DISTANCE = 4


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: a bit is 1 if it is set in over half of them; zero without any. A signed number."""
    if not len(hashes):
        return 0
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ SPREAD for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = shingles(text, words)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (a signed 64-bit number) for each row of ``df``.

    Whole texts are read, also very long ones. A null text counts as empty: its fingerprint is zero, like that of any text without a word. A null id
    stays null; repeated rows repeat; other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    schema = arrow_fields(doc_id="long", fp="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([print_of(shingle_hashes(t, words)) for t in rows.column(1).to_pylist()], pa.int64())], schema=schema)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), schema, run)


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints of ``a`` and ``b`` differ in ``most`` bits or fewer, as a matrix."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= most


def forest(rows: np.ndarray, most: int, block: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest (row, earlier row) of the links among ``rows``, each pair compared, in blocks."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(0, len(rows), block):
        for j in range(0, i + 1, block):
            for x, y in zip(*(v.tolist() for v in np.nonzero(near(rows[i : i + block], rows[j : j + block], most))), strict=True):
                p, q = find(i + x), find(j + y)
                if p != q:
                    edges.append((i + x, j + y))
                    root[max(p, q)] = min(p, q)
    return edges


LINKS = arrow_fields(a="long", b="long", bucket="long", member="long")


def bucket_links(filed: DataFrame, most: int, bucket: int) -> DataFrame:
    """From rows (key, fingerprint) sorted by key within their partition: links (a, b) of small buckets; (bucket, member) for large ones.

    Rows are read as a stream; no more than one small bucket is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size = None, 0
        held: list[np.ndarray] = []
        none = np.empty(0, np.int64)

        def rows(a: np.ndarray, b: np.ndarray, large: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
            gap = lambda n: pa.nulls(n, pa.int64())
            put = lambda x, before, after: pa.concat_arrays([gap(before), pa.array(x, pa.int64()), gap(after)])
            n, m = len(a), len(members)
            return pa.RecordBatch.from_arrays([put(a, 0, m), put(b, 0, m), put(large, n, 0), put(members, n, 0)], schema=LINKS)

        def close() -> Iterator[pa.RecordBatch]:
            if held and 1 < size <= bucket:
                fps = np.concatenate(held)
                if edges := forest(fps.view(np.uint64), most):
                    at = np.array(edges)
                    yield rows(fps[at[:, 0]], fps[at[:, 1]], none, none)

        def spill() -> Iterator[pa.RecordBatch]:
            for fps in held:
                yield rows(none, none, np.full(len(fps), key), fps)
            held.clear()

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            # A row whose key is its own needs no work, unless it stands at an end of the batch.
            lengths = np.diff(starts)
            busy = np.flatnonzero((lengths > 1) | (starts[:-1] == 0) | (starts[1:] == len(keys))).tolist()
            for i in busy:
                start, end = starts[i], starts[i + 1]
                if keys[start] != key:
                    yield from close()
                    key, size = keys[start], 0
                    held.clear()
                size += int(end - start)
                held.append(fps[start:end])
                if size > bucket:
                    yield from spill()
        yield from close()

    return map_batches(filed, LINKS, run)


def star_links(heavy: DataFrame) -> DataFrame:
    """Links (a, b) among fingerprints (``fp``) at a distance of four or less: stars of the values within two bits."""
    masks = [0, *(1 << i for i in range(64))]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks))
    # Two flips of one bit, in order: the empty flip, one bit, or two different ones.
    flips = F.expr("explode(filter(sequence(0, 64 * 65 - 1), x -> x div 65 < x % 65 OR x = 0))")
    points = heavy.repartition("fp").select("fp", flips.alias("x")).select("fp", F.col("fp").bitwiseXOR(F.element_at(signed, F.expr("cast(x div 65 as int) + 1"))).bitwiseXOR(F.element_at(signed, F.expr("cast(x % 65 as int) + 1"))).alias("y"))
    hubs = points.groupBy("y").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return points.join(hubs.drop("n"), "y").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def print_links(distinct: DataFrame, bucket: int = 4096) -> DataFrame:
    """Links (a, b) among distinct fingerprints (``fp``) that connect all those of four bits or fewer, and no others."""
    masks = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i).cast("bigint") for i in range(32)))
    halves = F.array(*(F.struct(F.lit(h).cast("bigint").alias("segment"), (F.shiftrightunsigned("fp", 32) if h else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("value")) for h in (0, 1)))
    # 32 bits of value below the number of the segment: one 64-bit key.
    segments = distinct.select("fp", F.explode(halves).alias("s")).select("fp", F.shiftleft("s.segment", 32).alias("base"), F.col("s.value").alias("value"))
    filed = segments.select("fp", "base", "value", F.explode(masks).alias("mask")).select((F.col("base") + F.col("value").bitwiseXOR(F.col("mask"))).alias("key"), "fp")
    found = materialize(bucket_links(filed.repartition("key").sortWithinPartitions("key"), DISTANCE, bucket), "simhash-links")
    links = found.where(F.col("a").isNotNull()).select("a", "b").distinct()
    large = found.where(F.col("member").isNotNull())
    return links if large.isEmpty() else links.unionByName(star_links(large.select(F.col("member").alias("fp")).distinct()))


def near_groups(prints: DataFrame, bucket: int = 4096) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for each row of :func:`fingerprints`.

    Fingerprints link at four bits or fewer, and no link is lost; documents with one fingerprint always link. The component's id is its smallest id;
    a null id belongs to its component but never names it, unless no other is there. Rows may repeat; an empty table gives an empty result. Jobs run while the result is built.
    """
    prints = materialize(prints, "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    named = named_components(connected_components(print_links(distinct.select("fp"), bucket)), distinct.select(F.col("fp").alias("node"), "least"))
    table = distinct.join(named.withColumnRenamed("node", "fp").withColumn("linked", F.lit(True)), "fp", "left")
    table = table.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n")
    return join_split(prints, table, "fp", prints.count()).select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(fingerprints(load_table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
