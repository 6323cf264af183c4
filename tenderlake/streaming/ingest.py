"""Streams: payloads that land in a folder are saved batch by batch; new publications meet the companies' interests. An extension."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tenderlake.plans.ingest import store_payloads
from tenderlake.schemas import PAYLOAD
from tenderlake.sources.store import Store


def payload_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Payload files (JSON lines) as they land."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_at_once).json(folder)


def save_stream(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Save what has landed and stop. Batches are stored under the names of the checkpoint and their number, so a batch that is replayed after a failure changes nothing that it has stored, and
    alerts that say the same as those of earlier batches are stored as often as they come."""
    name = re.sub(r"[^A-Za-z0-9]+", "-", checkpoint).strip("-")

    def save(batch: DataFrame, number: int) -> None:
        store_payloads(store, batch, F.current_timestamp(), f"{name}-{number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interest_stream(publications: DataFrame, company_topics: DataFrame, topic: str = "domaine_id", event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (company, publication) as publications stream in, once within the time that late ones are waited for. The companies' side is a table."""
    matched = publications.withWatermark(event_time, late).join(company_topics.select("entreprise_id", topic).distinct(), topic)
    return matched.dropDuplicatesWithinWatermark(["entreprise_id", "publication_id"])


def windowed_counts(events: DataFrame, event_time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window, late ones counted until the watermark has passed."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
