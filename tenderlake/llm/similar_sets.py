"""Near copies by fingerprints, and by the exact similarity of their shingle sets.

Two documents are near copies if their sets of shingles (64-bit hashes) have a Jaccard similarity of 0.8 or more, which is the same as
``9 * shared >= 4 * (size + size)``. Multi-index hashing of SimHash fingerprints (:mod:`~tenderlake.llm.simhash`) proposes the closest links at a low price. It can't find
all of them, since a fingerprint is an estimate; so a prefix filter finds the rest, exactly:

* All sets are sorted by one order. A pair of 0.8 or more shares a shingle among the first ``size // 5 + 1`` of both, so only those are filed.
  Any order serves; shingles that a sample finds to be common come last, which keeps the entries of the table small.
* At the first shared shingle no more than what follows it can be shared too. That and the sizes rule out many pairs without a look at the sets.
* A sketch of 512 bits holds for each of as many classes of shingles whether their number is odd. Where two sketches differ, the sets differ
  in at least one shingle of that class, and sets of 0.8 differ in a ninth of their sizes at most. That rules out nearly all other pairs of up to about 1,000 shingles.
  Larger sets have a wide sketch as well, of a bit or two for each shingle, which is compared before whole sets are: long documents that share a passage are many pairs, and each would carry a set.
* Two sets that meet in an entry and both have the same one as their last shared entry before have met there already, and aren't compared again.
* First each member of an entry is compared with the entry's smallest one, and the links, with those of the fingerprints, give components. Then only pairs of different
  components remain: a dense family is done with after the first round and costs no pairs.
* Sets are numbered by a 64-bit hash; a second hash tells when two sets have got one number, and those get others. Texts are told apart by their MD5 sums. So what counts as equal agrees in 128 bits.
* A pair is confirmed by its two whole sets. They are made again from the texts of the documents in question, so sets are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import SEED, SLICE, arrow_fields, join_split, map_batches, text_of, without_ids
from tenderlake.llm.components import connected_components, named_components
from tenderlake.llm.simhash import print_links, print_of, shingle_hashes
from tenderlake.sources.tables import discard, materialize

#: Words of 64 bits of a sketch.
SKETCH = 8
#: Bits of the widest sketch.
WIDEST = 1 << 20


#: Members of an entry that are compared with each other in one task.
CHUNK = 2000


def number_of(items: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A hash of a set, which serves as its number, and another one to check it by. Fewer bits are for tests."""
    raw = items.tobytes()
    number, check = np.array([xxhash.xxh64_intdigest(raw, SEED) >> (64 - bits), xxhash.xxh64_intdigest(raw, SEED + 1)], np.uint64).view(np.int64).tolist()
    return number, check


def renumbered(df: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """``df`` (``no, check``, others) without ``check``; sets whose number is among the few that clash get one from both hashes."""
    if clashing is None:
        return df.drop("check")
    met = df.join(F.broadcast(clashing.withColumn("_clash", F.lit(True))), "no", "left")
    return met.withColumn("no", F.when(F.col("_clash"), F.xxhash64("no", "check")).otherwise(F.col("no"))).select([c for c in df.columns if c != "check"])


def odd_classes(items: np.ndarray, bits: int) -> np.ndarray:
    """Of the ``bits`` classes (a power of two) that bits of a hash name, those with an odd number of items, packed to bytes."""
    odd = np.bincount((items.view(np.uint64) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch_of(items: np.ndarray) -> list[int]:
    return odd_classes(items, 64 * SKETCH).view(np.int64).tolist()


def wide_sketch_of(items: np.ndarray) -> bytes | None:
    """A sketch of at least a bit for each item; None if the short one has as many."""
    if len(items) <= 64 * SKETCH:
        return None
    return odd_classes(items, min(WIDEST, 1 << (len(items) - 1).bit_length())).tobytes()


def common_items(docs: DataFrame, words: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Items that are common in a sample of the texts (``mark, body``), in order, and how often. They only shape the order, never the result."""
    step = docs.count() // sample + 1
    picked = docs.where(F.pmod(F.xxhash64("mark"), F.lit(step)) == 0).dropDuplicates(["mark"])
    items = sets_of(picked, words, 64).select(F.explode("items").alias("item"))
    rows = items.groupBy("item").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "item").limit(most).toArrow()
    items, n = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(items)
    return items[order], n[order]


def sets_of(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``no, check`` and ``items`` of each text (``mark, body``)."""
    schema = arrow_fields(no="long", check="long", items=pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [np.unique(shingle_hashes(t, words).view(np.int64)) for t in batch.column(1).slice(at, 64).to_pylist()]
                ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                numbers = np.array([number_of(x, bits) for x in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[:, 0].copy()), pa.array(numbers[:, 1].copy()), items.cast(schema.field(2).type)], schema=schema)

    return map_batches(docs.select("mark", "body"), schema, run)


def summaries(docs: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """For each row (``doc_id, mark, body``): ``doc_id, mark, no, check``, fingerprint, size, sketches, and the set's first ``size // 5 + 1`` items, rare ones first."""
    known, often = common
    schema = arrow_fields(doc_id="long", mark="text", no="long", check="long", fp="long", size="long", sketch=pa.list_(pa.int64()), wide="bytes", prefix=pa.list_(pa.int64()))

    def first(items: np.ndarray) -> np.ndarray:
        n = len(items) // 5 + 1
        if not len(known):
            return items[:n]
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        return items[np.lexsort((items, np.where(known[at] == items, often[at], 0)))[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                out = []
                for text in rows.column(2).to_pylist():
                    hashes = shingle_hashes(text, words)
                    items = np.unique(hashes.view(np.int64))
                    out.append((*number_of(items, bits), print_of(hashes), len(items), sketch_of(items), wide_sketch_of(items), first(items)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return map_batches(docs.select("doc_id", "mark", "body"), schema, run)


def shared_entries(filed: DataFrame) -> DataFrame:
    """From rows (key, no, size, pos) sorted by key within their partition, those that aren't alone under their key, with their entry's first row (hub)."""
    schema = arrow_fields(key="long", no="long", size="long", pos="long", hub="long", hub_size="long", hub_pos="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, unless it has been passed on
        key, hub = None, None  # of the last entry so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            keys = columns[0]
            same = keys[1:] == keys[:-1]
            goes_on = key is not None and keys[0] == key
            shared = np.append(goes_on, same) | np.append(same, False)
            starts = np.flatnonzero(np.append(True, ~same))
            hubs = np.repeat(columns[1:, starts], np.diff(np.append(starts, len(keys))), axis=1)
            if goes_on:
                hubs[:, : starts[1] if len(starts) > 1 else len(keys)] = hub[:, None]
                if held is not None:
                    yield held
            key, hub = int(keys[-1]), hubs[:, -1].copy()
            whole = np.vstack([columns, hubs])
            make = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in part], schema=schema)
            held = None if shared[-1] else make(whole[:, -1:])
            if shared.any():
                yield make(whole[:, shared])

    return map_batches(filed, schema, run)


def may_link(a: str, b: str) -> Column:
    """Whether two sets that meet at their first shared item can reach 0.8, by sizes and positions alone."""
    return F.expr(f"9 * least({a}size - {a}pos, {b}size - {b}pos) >= 4 * ({a}size + {b}size)")


def close_sketches(a: str, b: str) -> Column:
    differ = " + ".join(f"bit_count({a}sketch[{i}] ^ {b}sketch[{i}])" for i in range(SKETCH))
    return F.expr(f"9 * ({differ}) <= {a}size + {b}size")


def likely(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Those of ``total`` pairs (a, b) whose sizes and sketches allow a similarity of 0.8."""
    for end in ("a", "b"):
        side = sets.select(F.col("no").alias(end), F.col("size").alias(f"{end}_size"), F.col("sketch").alias(f"{end}_sketch"))
        # An entry's hub, or a fingerprint's, has many pairs.
        pairs = join_split(pairs, side.join(pairs.groupBy(end).agg(F.count("*").alias("n")), end), end, total)
    return pairs.where(F.expr("9 * least(a_size, b_size) >= 4 * (a_size + b_size)")).where(close_sketches("a_", "b_")).select("a", "b")


def side_by_side(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b), written already, with what ``table`` (``no``, others) has for both ends, as ``a_...`` and ``b_...``. A hub's row goes once with each chunk of its partners."""
    end = lambda e: table.select(F.col("no").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in columns))
    chunks = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(max(64, pairs.count() // 100_000))).alias("chunk")).agg(F.collect_list("b").alias("bs"))
    return chunks.join(end("a"), "a").select("a", *(f"a_{c}" for c in columns), F.explode("bs").alias("b")).join(end("b"), "b")


def differing_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits sketches differ, two by two. Of two sizes, the larger is folded to the smaller, as its classes are parts of the other's."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for la, lb in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (la, lb)).all(1))
        least = min(la, lb)
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1, least // 8), axis=1) for side in (a, b)]
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(1)
    return out


def close_wide_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), written already, whose wide sketches allow a similarity of 0.8, or of which one has none."""
    schema = arrow_fields(a="long", b="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            both = np.flatnonzero([p is not None and q is not None for p, q in zip(x, y, strict=True)])
            stay = np.ones(batch.num_rows, bool)
            total = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            stay[both] = 9 * differing_bits([x[i] for i in both.tolist()], [y[i] for i in both.tolist()]) <= total[both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(stay))

    met = side_by_side(pairs, sets.select("no", "size", "wide"), ["size", "wide"])
    return map_batches(met.select("a", "b", "a_size", "b_size", "a_wide", "b_wide"), schema, run)


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, bits: int, clashing: DataFrame | None) -> DataFrame:
    """Those of the pairs (a, b), written already, whose whole sets have a similarity of 0.8 or more. ``sets`` has each set's number, the mark of a text that gives it, size and wide sketch."""
    pairs = materialize(close_wide_sketches(pairs, sets), "pairs-to-confirm")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    wanted = materialize(sets.join(wanted, "no", "left_semi").select("no", F.col("mark").alias("wanted")), "wanted-sets")
    side = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted
    texts = docs.join(side, F.col("mark") == F.col("wanted")).dropDuplicates(["mark"])
    held = materialize(renumbered(sets_of(texts, words, bits), clashing).join(wanted.select("no"), "no", "left_semi").dropDuplicates(["no"]), "held-sets")
    both = side_by_side(pairs, held, ["items"])
    links = materialize(both.where(9 * F.size(F.array_intersect("a_items", "b_items")) >= 4 * (F.size("a_items") + F.size("b_items"))).select("a", "b"), "similar-links")
    discard(pairs, wanted, held)
    return links


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 64, chunk: int = CHUNK) -> DataFrame:
    """``doc_id`` and ``component_id`` for each row of ``df``: the components of all pairs with a similarity of 0.8 or more.

    Documents with equal sets always link, empty ones too. The component's id is its smallest id; a null id belongs to its component but never
    names it, unless no other is there. Jobs run while the result is built. ``bits`` of the sets' numbers and the ``chunk`` of an entry that a task compares change nothing in the result.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_of(text_col).alias("body")).select("doc_id", F.md5("body").alias("mark"), "body")
    every = materialize(summaries(docs, words, common_items(docs, words), bits), "set-summaries")
    clashing = materialize(every.groupBy("no").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low != high").select("no"), "clashing-numbers")
    clashing = None if clashing.isEmpty() else clashing
    every = every.drop("check") if clashing is None else materialize(renumbered(every, clashing), "set-summaries")
    facts = F.min(F.struct("mark", "fp", "size", "sketch", "wide")).alias("f")
    sets = materialize(every.groupBy("no").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), facts).select("no", "least", "n", "f.*"), "distinct-sets")

    # Of the rows of one set one files its prefix. Rows of one text have equal prefixes, so they may all serve where they are few.
    several = sets.where("n > 1").select("no")
    alone = without_ids(every, "no", materialize(several, "copied-sets")).select("no", "size", "prefix")
    chosen = every.join(F.broadcast(several) if several.count() <= 500_000 else several, "no", "left_semi").groupBy("no", "size").agg(F.min("prefix").alias("prefix"))
    filed = alone.unionByName(chosen).where("size > 0").select(F.posexplode("prefix").alias("pos", "key"), "no", "size").select("key", "no", "size", F.col("pos").cast("bigint").alias("pos"))
    met = materialize(shared_entries(filed.repartition("key").sortWithinPartitions("key", "no")), "shared-shingles")
    stars = met.where(F.col("no") != F.col("hub")).where(may_link("", "hub_")).select(F.col("hub").alias("a"), F.col("no").alias("b"))

    # The fingerprints' links, each print standing for the first of its sets, and from there to the others.
    prints = materialize(sets.groupBy("fp").agg(F.min("no").alias("no"), F.count("*").alias("n")), "set-prints")
    linked = print_links(prints.select("fp"))
    for end in ("a", "b"):
        linked = linked.join(prints.select(F.col("fp").alias(end), F.col("no").alias(f"{end}_no")), end)
    same = join_split(sets.select("fp", F.col("no").alias("b")), prints.withColumnRenamed("no", "a"), "fp", sets.count()).where("a != b").select("a", "b")
    proposed = linked.select(F.least("a_no", "b_no").alias("a"), F.greatest("a_no", "b_no").alias("b")).unionByName(same)
    first = materialize(stars.unionByName(proposed).distinct(), "first-pairs")
    links = confirmed(materialize(likely(first, sets, first.count()), "likely-pairs"), sets, docs, words, bits, clashing)
    groups = connected_components(links)

    before = F.lag("key").over(Window.partitionBy("no").orderBy("pos")).alias("before")  # as many rows as one set has in its prefix
    labelled = met.select("key", "no", "size", "pos", before).join(groups.withColumnRenamed("node", "no"), "no", "left").withColumn("label", F.coalesce("component", "no")).drop("component")
    labelled = materialize(labelled, "labelled-shingles")
    discard(met)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("low != high").select("key", "chunks")
    rest = labelled.join(mixed, "key").join(sets.select("no", "sketch"), "no")
    meets = "a.key = b.key AND a.no < b.no AND a.label != b.label AND NOT coalesce(a.before = b.before, false)"
    meet = lambda left, right, also=F.lit(True): left.alias("a").join(right.alias("b"), F.expr(meets) & also & may_link("a.", "b.") & close_sketches("a.", "b.")).select(F.col("a.no").alias("a"), F.col("b.no").alias("b"))
    # Both sides of most entries are one plan, so they are shuffled once. An entry of very many members is dealt out to squares of chunks, so that no task compares all of them.
    small, large = rest.where("chunks = 1").drop("chunks"), rest.where("chunks > 1")
    own, every_chunk = F.pmod(F.xxhash64("no"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left, right = large.select("*", own.alias("row"), every_chunk.alias("column")), large.select("*", every_chunk.alias("row"), own.alias("column"))
    across = meet(small, small).unionByName(meet(left, right, F.expr("a.row = b.row AND a.column = b.column")))
    across = materialize(across.distinct(), "other-pairs")
    discard(labelled)
    across = materialize(across.join(first, ["a", "b"], "left_anti"), "other-pairs")
    more = confirmed(across, sets, docs, words, bits, clashing)
    if not more.isEmpty():
        groups = connected_components(groups.toDF("a", "b").unionByName(more))  # each component so far is a star

    named = named_components(groups, sets.select(F.col("no").alias("node"), "least"))
    table = sets.select("no", "least", "n").join(named.withColumnRenamed("node", "no").withColumn("linked", F.lit(True)), "no", "left")
    table = table.select("no", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n")
    return join_split(every.select("doc_id", "no"), table, "no", every.count()).select("doc_id", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``df`` without those that near-repeat another: of each group the row with the smallest id stays.

    Near copies are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Multi-index hashing of fingerprints proposes links, which the sets
    confirm; a fingerprint only estimates a similarity, so a prefix filter finds the links that it misses, and none is lost. Null texts count as empty,
    and empty texts are copies of each other. Rows with a null id stay, as nothing can name them; rows that repeat an id stay or go together. All columns are
    returned, whatever their names; an empty table gives an empty result. Jobs run while the result is built.
    """
    groups = similar_groups(df, id_col, text_col, words)
    gone = materialize(groups.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return without_ids(df, id_col, gone)
