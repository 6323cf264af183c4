"""Alerts from two streams: publications with their topics, and companies' interests in topics. Whichever comes second makes the alert, so a new interest also meets earlier publications.

For each topic the companies that follow it are remembered for good, publications for a time to live. Topics are spread over the cluster by key, and state is kept in RocksDB on the executors and in the
checkpoint, so it survives the loss of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tenderlake.sources.shipping import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBER = T.StructType([T.StructField("id", T.LongType())])
NOTHING = T.StructType([T.StructField("known", T.BooleanType())])


class MeetByTopic(StatefulProcessor):
    """Rows of a topic: ``entreprise_id`` or ``publication_id``, the other one null."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firms = handle.getMapState("firms", NUMBER, NOTHING)
        self.publications = handle.getMapState("publications", NUMBER, NOTHING, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            firms = self._fresh(self.firms, part["entreprise_id"])
            # Those that are known already meet the new publications, the new ones meet all.
            publications = self._fresh(self.publications, part["publication_id"])
            earlier = [p for p in self._all(self.publications) if p not in publications] if firms else []
            yield from self._pairs(firms, earlier)
            if publications:
                yield from self._pairs(self._all(self.firms), publications)

    @staticmethod
    def _all(state) -> list[int]:
        return [k[0] for k in state.keys()]

    @staticmethod
    def _fresh(state, values: pd.Series) -> set[int]:
        """The numbers that the state lacks; it has them afterwards."""
        out = set()
        for v in map(int, values.dropna().unique()):
            if not state.containsKey((v,)):
                state.updateValue((v,), (True,))
                out.add(v)
        return out

    @staticmethod
    def _pairs(firms, publications, size: int = 10_000) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int]] = []
        for f in firms:
            for p in publications:
                held.append((f, p))
                if len(held) >= size:
                    yield pd.DataFrame(held, columns=["entreprise_id", "publication_id"])
                    held = []
        if held:
            yield pd.DataFrame(held, columns=["entreprise_id", "publication_id"])

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """Lets the first row of each key pass, as long as it is remembered."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", NOTHING, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame([key], columns=["entreprise_id", "publication_id"])

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """State of this kind needs RocksDB; a session's setting that names another provider is an error."""
    found = spark.conf.get(PROVIDER, ROCKS)
    if not found.endswith("RocksDBStateStoreProvider") and "HDFSBacked" not in found:
        raise ValueError(f"{PROVIDER} names {found}, where RocksDB is needed")
    spark.conf.set(PROVIDER, ROCKS)


def alert_stream(publications: DataFrame, interests: DataFrame, publication: str = "publication_id", company: str = "entreprise_id", topic: str = "domaine_id", ttl_days: int = 90) -> DataFrame:
    """``entreprise_id, publication_id``: each pair that shares a topic, once, as soon as both are known. Both sides are streams; rows may repeat, null topics and ids meet nothing.

    A publication is remembered for ``ttl_days`` of processing time, interests for good. A pair that shares several topics is let through once within that time. For a trigger that ends by itself
    set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false: as time goes on, Spark would run empty batches without end.
    """
    spark = publications.sparkSession
    ship_package(spark)
    use_rocks(spark)
    none = F.lit(None).cast("long")
    rows = publications.select(F.col(topic).cast("long").alias("topic"), none.alias("entreprise_id"), F.col(publication).cast("long").alias("publication_id"))
    rows = rows.unionByName(interests.select(F.col(topic).cast("long").alias("topic"), F.col(company).cast("long").alias("entreprise_id"), none.alias("publication_id")))
    ttl, pair = ttl_days * 86_400_000, "entreprise_id long, publication_id long"
    met = rows.where("topic IS NOT NULL").groupBy("topic").transformWithStateInPandas(MeetByTopic(ttl), pair, "Append", "ProcessingTime")
    return met.groupBy("entreprise_id", "publication_id").transformWithStateInPandas(Once(ttl), pair, "Append", "ProcessingTime")
