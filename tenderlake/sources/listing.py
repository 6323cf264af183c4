"""Listing pages of sites as a data source, batch and stream, and the contents behind URLs.

``spark.readStream.format("page_listing").option("urls", "<one address a line>").load()`` gives a row for each listing page whenever it has changed. The offset of a stream is the version of each page: what the
server says (``ETag``, else ``Last-Modified`` with ``Content-Length``), or a digest of the body if it says nothing. A page whose version is that of the offset isn't fetched again, not even after a restart.
A batch that is replayed after a failure fetches its pages as they are by then; what follows (:mod:`tenderlake.streaming.listing`) stores each file name once, so that does no harm.

Addresses of pages are settings and travel through the driver; the pages themselves are fetched by tasks.
"""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tenderlake.sources.shipping import ship_package

ROWS = "url string, status int, html string, error string"
FETCHED = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("error", pa.string())])


def get(url: str, timeout: float, method: str = "GET") -> tuple[int, dict[str, str], bytes]:
    """Status, headers (names in lower case) and body of an answer, whatever its status. Raises if there is none."""
    request = urllib.request.Request(url, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status or 200, {k.lower(): v for k, v in answer.headers.items()}, answer.read()
    except urllib.error.HTTPError as e:
        with e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def version(url: str, timeout: float) -> str | None:
    """What tells two states of a page apart; None if it can't be reached or doesn't answer with 200."""
    try:
        status, headers, _ = get(url, timeout, "HEAD")
        if status == 200 and "etag" in headers:
            return headers["etag"]
        if status == 200 and "last-modified" in headers:
            return f"{headers['last-modified']} {headers.get('content-length', '')}"
        status, _, body = get(url, timeout)
        return hashlib.sha256(body).hexdigest() if status == 200 else None
    except (OSError, ValueError):
        return None


@dataclass
class Addresses(InputPartition):
    urls: list[str]


class _Listing:
    def __init__(self, options) -> None:
        self.urls = list(dict.fromkeys(u.strip() for u in options["urls"].splitlines() if u.strip()))
        self.timeout = float(options.get("timeout", 30))
        self.each = int(options.get("pagesPerTask", 8))

    def dealt(self, urls: list[str]) -> list[Addresses]:
        return [Addresses(urls[i : i + self.each]) for i in range(0, len(urls), self.each)]

    def rows(self, partition: Addresses) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                status, _, body = get(url, self.timeout)
                yield url, status, body.decode("utf-8", "replace"), None
            except (OSError, ValueError) as e:
                yield url, None, None, f"{type(e).__name__}: {e}"


class ListingReader(_Listing, DataSourceReader):
    def partitions(self) -> list[Addresses]:
        return self.dealt(self.urls) or [Addresses([])]

    def read(self, partition: Addresses) -> Iterator[tuple]:
        return self.rows(partition)


class ListingStreamReader(_Listing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # A page that doesn't answer is left out; it comes once it does.
        return {u: v for u in self.urls if (v := version(u, self.timeout)) is not None}

    def partitions(self, start: dict, end: dict) -> list[Addresses]:
        return self.dealt([u for u, v in end.items() if start.get(u) != v])

    def read(self, partition: Addresses) -> Iterator[tuple]:
        return self.rows(partition)


class PageListing(DataSource):
    """Options: ``urls`` (one a line; repeats count once), ``timeout`` in seconds, ``pagesPerTask``. A page that can't be reached is a row with an error in a batch read, and waited for in a stream."""

    @classmethod
    def name(cls) -> str:
        return "page_listing"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStreamReader(self.options)


def read_listing(spark: SparkSession, urls: list[str], timeout: float = 30) -> DataFrame:
    """The pages as they are now: ``url, status, html, error``."""
    ship_package(spark)
    spark.dataSource.register(PageListing)
    return spark.read.format("page_listing").option("urls", "\n".join(urls)).option("timeout", timeout).load()


def listing_stream(spark: SparkSession, urls: list[str], timeout: float = 30) -> DataFrame:
    """The pages whenever they have changed."""
    ship_package(spark)
    spark.dataSource.register(PageListing)
    return spark.readStream.format("page_listing").option("urls", "\n".join(urls)).option("timeout", timeout).load()


def fetch(urls: DataFrame, url: str = "file_url", timeout: float = 30) -> DataFrame:
    """``url, status, content, error``, a row for each row of ``urls``. A null URL or one without an answer has a null status. A file is one value, so it must fit in a task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.column(0).to_pylist():
                try:
                    status, _, body = get(u or "", timeout)
                    row = (u, status, body if status == 200 else None, None)
                except (OSError, ValueError) as e:
                    row = (u, None, None, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_pylist([dict(zip(FETCHED.names, row, strict=True))], schema=FETCHED)

    ship_package(urls.sparkSession)
    return urls.select(url).mapInArrow(run, "url string, status int, content binary, error string")
