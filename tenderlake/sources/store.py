"""The catalogue's tables in storage: Spark's own tables, bucketed by natural key, to which only new rows are added.

A batch meets a stored table by the key that the table is bucketed by, so the stored side is read where it lies, without a shuffle, and only the batch's keys travel. What the batch adds is appended;
nothing that is stored is written again.

There is one writer at a time. A batch touches several tables, one after the other; readers may see some of them before the others. A get-or-create that is repeated after a failure finds what it has
written already. Rows that are always inserted (alerts) carry the batch that brought them and replace what an earlier attempt at the same batch has written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.numbering import number_rows
from tenderlake.operators.upsert import first_wins
from tenderlake.schemas import TABLES
from tenderlake.sources.tables import materialize

#: The column of tables without a natural key that says which batch a row came with.
BATCH = "batch"


class Store:
    """The tables below a database. ``buckets`` holds for tables that are made now; the number of a table that exists stays."""

    def __init__(self, spark: SparkSession, database: str = "tenderlake", buckets: int = 64, most: int = 1_000_000) -> None:
        """Up to ``most`` keys of a batch are broadcast to a stored table; beyond that they are shuffled to its buckets."""
        self.spark, self.database, self.most = spark, database, most
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, table in TABLES.items():
            if not spark.catalog.tableExists(f"{database}.{name}"):
                empty = spark.createDataFrame([], table.schema)
                if table.natural_key:
                    empty.write.format("parquet").bucketBy(buckets, *table.natural_key).saveAsTable(f"{database}.{name}")
                else:
                    empty.withColumn(BATCH, F.lit("")).write.format("parquet").partitionBy(BATCH).saveAsTable(f"{database}.{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}").drop(BATCH)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def _meeting(self, name: str, keys: DataFrame) -> DataFrame:
        """The stored rows whose natural key is among ``keys`` (distinct, written already). Null equals null."""
        columns = list(TABLES[name].natural_key)
        stored, side = self.table(name), keys.select(*(F.col(c).alias(f"__{c}") for c in columns))
        odd = lambda prefix: " OR ".join(f"`{prefix}{c}` IS NULL" for c in columns)
        many, nulls = side.agg(F.count("*"), F.count_if(F.expr(odd("__")))).first()
        # Of the two sides the batch's is hashed; the stored one streams by, bucket by bucket.
        whole = F.broadcast(side) if many <= self.most else side.hint("shuffle_hash")
        met = stored.join(whole, [F.col(c) == F.col(f"__{c}") for c in columns], "left_semi")
        if nulls:
            # Keys with a null aren't met by bucket. They are few by nature, and the filter on the stored side reaches the scan.
            met = met.unionByName(stored.where(odd("")).join(side.where(odd("__")), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left_semi"))
        return met

    def missing(self, name: str, rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        """Of ``rows`` whose natural key isn't stored the first of each key."""
        columns = list(TABLES[name].natural_key)
        first = materialize(first_wins(rows, columns, order), f"{name}-batch")
        side = self._meeting(name, first).select(*(F.col(c).alias(f"__{c}") for c in columns))
        return first.join(side, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left_anti")

    def get_or_create(self, name: str, rows: DataFrame, order: Sequence[str | Column]) -> None:
        """Append, of the rows whose natural key isn't stored, the first of each key, with an id if the table has one."""
        self._append(name, self.missing(name, rows, order), order)

    def add_links(self, name: str, pairs: DataFrame) -> None:
        left, right = TABLES[name].natural_key
        new = pairs.select(left, right).dropna()
        self._append(name, self.missing(name, new, [left, right]), [left, right])

    def insert(self, name: str, rows: DataFrame, order: Sequence[str | Column], batch: str) -> None:
        """Append all rows of a batch to a table without a natural key. The same batch replaces what it has inserted before."""
        self._append(name, rows, order, batch)

    def ids(self, name: str, keys: DataFrame) -> DataFrame:
        """For each of the natural keys that is stored: the key's columns and the smallest ``id``."""
        columns = list(TABLES[name].natural_key)
        wanted = materialize(keys.select(*columns).distinct(), f"{name}-keys")
        return self._meeting(name, wanted).groupBy(*columns).agg(F.min(TABLES[name].key).alias("id"))

    def _append(self, name: str, rows: DataFrame, order: Sequence[str | Column], batch: str | None = None) -> None:
        table = TABLES[name]
        if table.key == "id":
            # Numbered from 0 before it is known how many there are.
            rows = number_rows(rows, "id", order, 0)
            rows = rows.withColumn("id", F.col("id") + self._reserve(name, rows.count()))
        typed = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))
        target = f"{self.database}.{name}"
        if table.natural_key:
            # One file for a bucket that gets rows.
            dealt = typed.repartition(self._buckets(name), *table.natural_key)
            dealt.write.insertInto(target)
        else:
            # Of all partitions only this batch's is replaced. A stream's batch has a session of its own.
            typed.sparkSession.sql(f"INSERT OVERWRITE TABLE {target} PARTITION ({BATCH} = :batch) SELECT * FROM {{rows}}", args={"batch": batch}, rows=typed)

    def _buckets(self, name: str) -> int:
        found = self.spark.sql(f"DESCRIBE EXTENDED {self.database}.{name}").where("col_name = 'Num Buckets'").first()
        return int(found["data_type"])

    def _reserve(self, name: str, n: int) -> int:
        """The first of ``n`` new ids. The next free one is a property of the table and is moved on before anything is written, so a failure leaves a gap at worst."""
        target = f"{self.database}.{name}"
        value = self.spark.sql(f"SHOW TBLPROPERTIES {target}").where("key = 'tenderlake.next_id'").first()
        free = int(value["value"]) if value else (self.table(name).agg(F.max("id")).first()[0] or 0) + 1
        self.spark.sql(f"ALTER TABLE {target} SET TBLPROPERTIES ('tenderlake.next_id' = '{free + n}')")
        return free
