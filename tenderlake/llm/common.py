"""Small helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tenderlake.sources.shipping import ship_package
from tenderlake.sources.tables import materialize

#: Rows that a Python worker turns into Python objects at a time.
SLICE = 256
#: Bytes of text that a model is fitted on.
SAMPLE_BYTES = 128 << 20
#: Of the hashes of shingles.
SEED = 42


def text_of(column: str) -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str, words: int) -> list[bytes]:
    """Each ``words`` words in a row, repeats included; of fewer words the whole; of none, nothing."""
    # Of bytes, lower() and split() know ASCII only: A-Z, and the blanks from tab to carriage return and the space.
    parts = text.encode().lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    return [line[a:b] for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def bounded_batches(df: DataFrame) -> None:
    """Keep Arrow batches small by bytes as well as rows: one batch of very long texts must not fill a worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def arrow_fields(**kinds: str | pa.DataType) -> pa.Schema:
    """An Arrow schema from names and types; ``long``, ``text``, ``real``, ``flag`` and ``bytes`` stand for the common ones."""
    named = {"long": pa.int64(), "text": pa.string(), "real": pa.float64(), "flag": pa.bool_(), "bytes": pa.binary()}
    return pa.schema([(k, named[v] if isinstance(v, str) else v) for k, v in kinds.items()])


def map_batches(df: DataFrame, schema: pa.Schema, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with an Arrow schema and bounded batches."""
    ship_package(df.sparkSession)
    bounded_batches(df)
    return df.mapInArrow(run, from_arrow_schema(schema))


def map_rows(df: DataFrame, schema: pa.Schema, make: Callable[[], Callable[..., list[list]]], size: int = SLICE) -> DataFrame:
    """Apply a function to the columns of ``df``, a slice of ``size`` rows at a time, inside the tasks of its partitions.

    ``make`` is called once a task and gives the function; that gets one list for each column and returns one list
    for each field of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                rows = batch.slice(start, size)
                out = work(*(column.to_pylist() for column in rows.columns))
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(out, schema, strict=True)], schema=schema)

    return map_batches(df, schema, run)


def without_ids(df: DataFrame, id_col: str, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose id is not among ``ids`` (one column of distinct 64-bit numbers, written already). A null id is never among them.

    The ids are counted: up to ``most`` (8 MB) they are broadcast and the rows stay where they are; beyond that both sides are shuffled by id.
    """
    key = free_name(df, "lost_id")
    side = ids.select(F.col(ids.columns[0]).alias(key))
    side = F.broadcast(side) if side.count() <= most else side
    return df.join(side, F.col(f"`{id_col}`").cast("bigint") == F.col(key), "left_anti")


def within_bytes(sample: DataFrame, id_col: str, most: int, text: str = "body") -> DataFrame:
    """Of a sample that is bounded by rows, one an id, what is bounded by bytes as well: whole texts in the order of the ids' hashes, up to ``most`` bytes together.

    A text of more than a 64th of that isn't in it, so a single one can't take the others' place. The sample is written once, and the result may go to ``discard`` when it has been read; only ids and
    lengths meet in one task, as many as the sample has rows.
    """
    sample = materialize(sample, "sample")
    size, upto, chosen = (free_name(sample, n) for n in ("size", "upto", "within_id"))
    sizes = sample.select(F.col(id_col).alias(chosen), F.octet_length(text).cast("bigint").alias(size)).where(F.col(size) <= max(1, most // 64))
    sizes = sizes.withColumn(upto, F.sum(size).over(Window.orderBy(F.xxhash64(chosen), chosen))).where(F.col(upto) <= most)
    out = sample.join(F.broadcast(sizes.select(chosen)), F.col(id_col).eqNullSafe(F.col(chosen)), "left_semi")
    out._written_to = sample._written_to
    return out


def join_split(rows: DataFrame, table: DataFrame, key: str, total: int, parts: int = 20_000, least: int = 1000) -> DataFrame:
    """``rows`` with what ``table`` has for their ``key``. The table has each key once, none null, and by ``n`` how many of the ``total`` rows have it.

    Keys of more than ``max(least, total / parts)`` rows, which are ``parts`` at most, are broadcast, so their rows stay where they are; the others meet in a shuffle, where none is hot.
    """
    limit = max(least, total // parts)
    hot = F.broadcast(table.where(F.col("n") > limit).drop("n"))
    cold = table.where(F.col("n") <= limit).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def free_name(df: DataFrame, base: str) -> str:
    """A column name near ``base`` that ``df`` doesn't use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
