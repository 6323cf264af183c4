"""New files of listing pages, batch by batch: links of changed pages meet the manifest of stored names behind a Bloom filter, and only what is new is fetched.

The manifest is a table by batch. Beside it stand filters of its names, merged in a tree: a batch writes one of its own, and whenever ``fan`` filters of a level are complete they become one of the next level. So a
batch reads at most ``fan - 1`` filters of each level, and which ones follows from its number alone. A batch that is replayed reads what was there before it and replaces what it has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tenderlake.operators.bloom import SCHEMA, bloom_filter, merged, missing_from, words_for
from tenderlake.operators.documents import document_urls, named_urls
from tenderlake.operators.upsert import first_wins
from tenderlake.sources.listing import fetch
from tenderlake.sources.pdf import write_files
from tenderlake.sources.tables import materialize

STORED = "file_name string, file_url string"


def blocks(n: int, fan: int) -> list[tuple[int, int]]:
    """Whole blocks (level, first batch) that make up the batches from 0 to ``n - 1``, the largest first."""
    out, first = [], 0
    while first < n:
        level = 0
        while first % fan ** (level + 1) == 0 and first + fan ** (level + 1) <= n:
            level += 1
        out.append((level, first))
        first += fan**level
    return out


class Manifest:
    """Names of stored files below ``folder``, which the driver and all executors share. ``names`` says how many the filters are made for; with more, results stay right and more of the manifest is read."""

    def __init__(self, spark: SparkSession, folder: str, names: int = 1 << 24, fan: int = 8) -> None:
        self.spark, self.folder, self.words, self.fan = spark, folder.rstrip("/"), words_for(names), fan

    def stored(self, before: int) -> DataFrame:
        """What the batches before this one have stored: ``file_name, file_url``."""
        if before == 0:
            return self.spark.createDataFrame([], STORED)
        found = self.spark.read.schema(f"{STORED}, batch long").parquet(f"{self.folder}/manifest")
        return found.where(F.col("batch") < before).drop("batch")

    def filters(self, before: int) -> DataFrame:
        paths = [self._filter(level, first) for level, first in blocks(before, self.fan)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def missing(self, rows: DataFrame, before: int) -> DataFrame:
        """The rows whose ``file_name`` no batch before this one has stored."""
        return missing_from(rows, self.stored(before), self.filters(before), "file_name", self.words)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store a batch's names, in place of those that an earlier attempt has stored. Batches are numbered from 0 without a gap."""
        target = f"{self.folder}/manifest/batch={batch}"
        rows.select("file_name", "file_url").write.mode("overwrite").parquet(target)
        names = self.spark.read.schema(STORED).parquet(target)
        bloom_filter(names, "file_name", self.words).write.mode("overwrite").parquet(self._filter(0, batch))
        level = 1
        while (batch + 1) % self.fan**level == 0:
            first, step = batch + 1 - self.fan**level, self.fan ** (level - 1)
            parts = [self._filter(level - 1, first + i * step) for i in range(self.fan)]
            merged(self.spark.read.schema(SCHEMA).parquet(*parts)).write.mode("overwrite").parquet(self._filter(level, first))
            level += 1

    def _filter(self, level: int, first: int) -> str:
        return f"{self.folder}/filters/{level}-{first}"


def fetch_batch(pages: DataFrame, manifest: Manifest, batch: int, files: str, parts: tuple[str, ...] = (".pdf", ".docx"), get: Callable[[DataFrame], DataFrame] = fetch) -> None:
    """Store the files that a batch of listing pages (``url, status, html``) links to and that no earlier batch has stored: for each name the first URL, in order of page and place, that answers with 200.

    A name whose URLs all fail isn't stored and is tried again when its page changes. Of pages only those that answered with 200 count. A link without a name (null or empty) is passed over.
    """
    links = named_urls(document_urls(pages.where("status = 200").select("url", "html"), parts=parts)).where("file_name != ''")
    wanted = first_wins(links.select("file_name", "file_url", "url", "position"), ["file_name", "file_url"], ["url", "position"])
    wanted = materialize(wanted, "links")
    new = manifest.missing(wanted.select("file_name").distinct(), batch)
    candidates = materialize(wanted.join(new, "file_name", "left_semi"), "candidates")
    answers = materialize(get(candidates.select("file_url").distinct()), "answers")
    # Contents are shuffled only for the URLs that win.
    good = candidates.join(answers.where("status = 200").select(F.col("url").alias("file_url")), "file_url", "left_semi")
    winners = materialize(first_wins(good, ["file_name"], ["url", "position"]), "winners")
    bodies = answers.where("status = 200").select(F.col("url").alias("file_url"), "content")
    write_files(winners.select("file_name", "file_url").join(bodies, "file_url"), files, "file_name", "content")
    # Last, so that a name in the manifest always has its file.
    manifest.add(winners, batch)


def fetch_stream(pages: DataFrame, folder: str, files: str, checkpoint: str, names: int = 1 << 24, **options) -> StreamingQuery:
    """Fetch what the changed pages of :func:`tenderlake.sources.listing.listing_stream` link to, and stop. The manifest in ``folder`` belongs to this checkpoint, whose numbers of batches it uses."""

    def run(batch: DataFrame, number: int) -> None:
        fetch_batch(materialize(batch, "pages"), Manifest(batch.sparkSession, folder, names), number, files, **options)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
