"""Files in and out: directories by suffix, paged documents, payloads, text and page sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.pdf import Pdf
from tenderlake.schemas import PAYLOAD
from tenderlake.sources.shipping import ship_package


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files of a folder with the suffix: ``path, modificationTime, length, content``. The content is read only if a plan uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page_no`` (from 0)``, text`` and ``error`` of each page of each file (``path, content``), wherever Spark reads files from. A file that can't be read is one row with an error.

    A task takes a file as a whole; :func:`tenderlake.sources.pdf.read_pages` splits large files.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    pdf = Pdf.of(content)
                    for page in pdf.pages():
                        rows.append((path, page.number, pdf.text(page), None))
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInPandas(pages, "path string, page_no int, text string, error string")


def read_text_pages(files: DataFrame, mark: str = "\f") -> DataFrame:
    """As :func:`read_pdf_pages` for UTF-8 text files whose pages end with a form feed."""
    text = F.decode("content", "UTF-8")
    return files.select("path", F.posexplode(F.split(text, mark)).alias("page_no", "text"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Extraction payloads, one JSON object a line. A line that isn't JSON gives nulls."""
    return spark.read.schema(PAYLOAD).json(path)


def parse_payloads(df: DataFrame, column: str = "body") -> DataFrame:
    """Payloads from a column of JSON texts."""
    return df.select(F.from_json(column, PAYLOAD).alias("_p")).select("_p.*")


def read_config(path: str) -> dict | None:
    """A YAML file of settings, read on the driver; None if it isn't there or is empty."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except FileNotFoundError:
        return None


def write_texts(df: DataFrame, folder: str, name: str = "file_name", text: str = "text") -> None:
    """Texts by name, always overwriting: a Parquet table of ``name, text``, spread over its partitions."""
    df.select(F.replace(F.col(name), F.lit(".pdf"), F.lit(".txt")).alias(name), text).write.mode("overwrite").parquet(folder)


def write_pages(df: DataFrame, folder: str, doc: str = "doc_id") -> None:
    """Pages as a table, in 256 folders by the document's hash: a document's pages stand together, and no folder lists all documents. For a file a page: :mod:`tenderlake.sources.pdf`."""
    dealt = df.withColumn("part", F.pmod(F.hash(doc), F.lit(256)))
    dealt.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)


def to_json_rows(df: DataFrame, name: str = "body") -> DataFrame:
    """Each row as a JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def schema_document(df: DataFrame) -> str:
    """The schema as JSON, for a service's description."""
    return df.schema.json()
