"""PDF files as tables of pages, and files by name as a sink: two data sources.

``spark.read.format("pdf_pages").load(folder)`` gives a row for each page. Small files share a partition, up to ``splitBytes`` together; a larger file is split by ranges of pages, and each task reads
only what its pages need. ``df.write.format("named_files").mode("append").save(folder)`` writes each row as a file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tenderlake.functions.pdf import Pdf
from tenderlake.sources.shipping import ship_package

PAGES = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("n_pages", pa.int32()), ("text", pa.string()), ("error", pa.string())])


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")


def opened(files: arrow_fs.FileSystem, path: str) -> Pdf:
    f = files.open_input_file(path)

    def read(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    return Pdf(f.size(), read)


@dataclass
class Pages(InputPartition):
    """Files, each with its range of pages; an end of None is the last page."""

    files: list[tuple[str, int, int | None]]


class PdfPagesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.suffix = options.get("suffix", ".pdf")
        self.split = int(options.get("splitBytes", 16 << 20))
        page = options.get("page")
        self.page = None if page is None else int(page)

    def partitions(self) -> list[Pages]:
        files, base = located(self.root)
        found = files.get_file_info(arrow_fs.FileSelector(base, recursive=True)) if files.get_file_info(base).type == arrow_fs.FileType.Directory else [files.get_file_info(base)]
        listed = sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and f.path.endswith(self.suffix))
        out, held, size = [], [], 0
        for path, n in listed:
            if n > self.split and self.page is None:
                try:
                    pages = opened(files, path).n_pages()
                except Exception:  # the task that reads it reports it
                    pages = 1
                each = max(1, -(-pages // -(-n // self.split)))
                out += [Pages([(path, a, min(a + each, pages))]) for a in range(0, pages, each)]
                continue
            held.append((path, 0, None))
            size += n
            if size >= self.split:
                out.append(Pages(held))
                held, size = [], 0
        return [*out, *([Pages(held)] if held else [])] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.root)
        for path, first, end in partition.files:
            rows: list[tuple] = []
            try:
                pdf = opened(files, path)
                n = pdf.n_pages()
                if self.page is not None:
                    first, end = self.page, self.page + 1
                for page in pdf.pages(first, end):
                    try:
                        rows.append((path, page.number, n, pdf.text(page), None))
                    except Exception as e:
                        rows.append((path, page.number, n, None, f"{type(e).__name__}: {e}"))
                    if len(rows) >= 64:
                        yield self._batch(rows)
                        rows = []
            except Exception as e:
                rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PAGES, strict=True)], schema=PAGES)


class PdfPages(DataSource):
    """Options: ``suffix`` of files that count, ``splitBytes``, and ``page`` for one page of each file (from 0)."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, page_no int, n_pages int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PdfPagesReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """Pairs of a temporary and a final path."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceWriter):
    """Each task writes its files below a folder of the write's own; they get their names when all tasks are done. A task that fails leaves nothing under a final name."""

    def __init__(self, options) -> None:
        self.root, self.job = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        files, base = located(self.root)
        done = []
        folder = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        for i, row in enumerate(rows):
            name = posixpath.normpath(row["name"])
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"{row['name']} is no name of a file below the folder")
            with files.open_output_stream(f"{folder}/{i}") as f:
                f.write(bytes(row["content"]))
            done.append((f"{folder}/{i}", f"{base}/{name}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = located(self.root)
        made: set[str] = set()
        for m in messages:
            for now, then in m.files if m else ():
                folder = posixpath.dirname(then)
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                files.move(now, then)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, base = located(self.root)
        folder = f"{base}/_temporary-{self.job}"
        if files.get_file_info(folder).type == arrow_fs.FileType.Directory:
            files.delete_dir(folder)


class NamedFiles(DataSource):
    """A sink of rows ``name, content``: a file each, that replaces one of that name."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make both data sources known to the session."""
    ship_package(spark)
    spark.dataSource.register(PdfPages)
    spark.dataSource.register(NamedFiles)


def read_pages(spark: SparkSession, folder: str, page: int | None = None, split_bytes: int = 16 << 20) -> DataFrame:
    """``path, page_no`` (from 0)``, n_pages, text, error`` of all PDF files below a folder. What can't be read is a row with an error: a file with a null page, or a page. ``page``: only
    that one of each file that has it."""
    register(spark)
    reader = spark.read.format("pdf_pages").option("splitBytes", split_bytes)
    return (reader if page is None else reader.option("page", page)).load(folder)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Each row as a file; of rows with one name one stays. Rows are dealt by name, so that no task writes most of them."""
    register(df.sparkSession)
    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    rows.dropDuplicates(["name"]).write.format("named_files").mode("append").save(folder)


def in_fan(name: F.Column) -> F.Column:
    """The name below one of 256 folders, by its first part's hash, so that no folder lists all documents."""
    return F.concat(F.substring(F.md5(F.substring_index(name, "/", 1)), 1, 2), F.lit("/"), name)


def write_text_files(pages: DataFrame, folder: str, fan: bool = False) -> None:
    """From rows of :func:`read_pages`: a text file for each PDF file, named after it, with its pages' texts one behind the other and nothing between."""
    entry = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    whole = pages.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("p")).select(F.substring_index("path", "/", -1).alias("file"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    name = F.replace("file", F.lit(".pdf"), F.lit(".txt"))
    write_files(whole.select((in_fan(name) if fan else name).alias("name"), F.encode("text", "UTF-8").alias("content")), folder)


PARTS = pa.schema([("name", pa.string()), ("content", pa.binary())])


def split_pdfs(files: DataFrame, trim: bool = True, whole: bool = True, singles: bool = True) -> DataFrame:
    """``name, content`` of PDF files made from ``files`` (``path, content``): the document without its first and last page under its own name (``whole``), and each page that is left as ``<document>/page_<i>.pdf``,
    from 1 (``singles``). With ``trim``, documents of up to two pages are passed over; without, all pages stay. What can't be read is passed over; :func:`read_pages` reports it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pdf = Pdf.of(content)
                    n = pdf.n_pages()
                    if trim and n <= 2:
                        continue
                    kept = list(range(n))[1:-1] if trim else list(range(n))
                    file = path.rsplit("/", 1)[-1]
                    made = [(file, pdf.copy_pages(kept))] if whole else []
                    made += [(f"{file.replace('.pdf', '')}/page_{i}.pdf", pdf.copy_pages([k])) for i, k in enumerate(kept, 1)] if singles else []
                except Exception:
                    continue
                for part in made:
                    yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, part, strict=True))], schema=PARTS)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "name string, content binary")
