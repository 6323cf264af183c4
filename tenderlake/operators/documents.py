"""Crawled pages and paged documents: links, new files, trimming, splitting, text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.html import hrefs
from tenderlake.functions.urls import basename, prefixed, resolve, url_path
from tenderlake.operators.upsert import first_wins


def extract_links(pages: DataFrame, html: str = "html", links: Column | None = None) -> DataFrame:
    """One row for each anchor: the page's other columns, ``position`` in the page from 0, ``href``."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(hrefs(F.col(html)) if links is None else links).alias("position", "href"))


def links_containing(links: DataFrame, parts: tuple[str, ...] = (".pdf", ".docx"), href: str = "href") -> DataFrame:
    """Links that hold one of the parts anywhere, in that case."""
    return links.where(reduce(or_, (F.col(href).contains(p) for p in parts)))


def links_ending(links: DataFrame, suffix: str = ".pdf", href: str = "href") -> DataFrame:
    return links.where(F.col(href).endswith(suffix))


def document_urls(pages: DataFrame, url: str = "url", html: str = "html", parts: tuple[str, ...] = (".pdf", ".docx")) -> DataFrame:
    """The page crawler: links of all pages that hold one of the parts, resolved against their page, as ``file_url``."""
    links = links_containing(extract_links(pages, html), parts)
    return links.withColumn("file_url", resolve(F.col(url), F.col("href")))


def listed_urls(pages: DataFrame, site: str, html: str = "html", suffix: str = ".pdf") -> DataFrame:
    """The listing crawler: links with the suffix, behind the site's address unless absolute, as ``file_url``."""
    return links_ending(extract_links(pages, html), suffix).withColumn("file_url", prefixed(site, F.col("href")))


def named_urls(urls: DataFrame, url: str = "file_url", by_path: bool = True) -> DataFrame:
    """``urls`` with ``file_name``: the base name of the URL's path, or of the whole URL unless ``by_path``."""
    return urls.withColumn("file_name", basename(url_path(url)) if by_path else basename(url))


def files_to_fetch(urls: DataFrame, manifest: DataFrame, order: list[str], url: str = "file_url", by_path: bool = True, status: str | None = "status") -> DataFrame:
    """What an idempotent fetch stores: for each file name that ``manifest`` (column ``file_name``) lacks, the first URL.

    The name is the base name of the URL's path, or of the whole URL unless ``by_path``. With a column ``status``, only answers of 200 are stored, and the
    first such URL of a name wins; without one, whatever comes first.
    """
    named = named_urls(urls, url, by_path)
    if status:
        named = named.where(F.col(status) == 200)
    # First what is missing, then the first of each name: the manifest can be much larger than the batch.
    missing = named.join(manifest.select("file_name"), "file_name", "left_anti")
    return first_wins(missing, ["file_name"], order)


def page_bounds(pages: DataFrame, doc: str, page: str) -> DataFrame:
    return pages.groupBy(doc).agg(F.min(page).alias("_first"), F.max(page).alias("_last"), F.count("*").alias("_pages"))


def trim_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", more_than: int = 2) -> DataFrame:
    """Documents of more than two pages without their first and last one; the others are skipped. Page numbers are unique within a document.

    Bounds come from an aggregate and meet the pages in a join, so a document of very many pages needn't be sorted in one task.
    """
    bounds = page_bounds(pages, doc, page).where(F.col("_pages") > more_than)
    inside = pages.join(bounds, doc).where((F.col(page) > F.col("_first")) & (F.col(page) < F.col("_last")))
    return inside.select(*pages.columns)


def split_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Each page as a file of its own: ``file_name`` is ``page_1.pdf`` for the smallest page number, and so on by rank."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    return pages.withColumn("file_name", F.format_string("page_%d.pdf", rank))


def full_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """``doc`` and ``text``: the pages' texts in order, with nothing between; a null text counts as empty."""
    entry = F.struct(F.col(page), F.coalesce(text, F.lit("")).alias("_text"))
    gathered = pages.groupBy(doc).agg(F.array_sort(F.collect_list(entry)).alias("_pages"))
    return gathered.select(doc, F.array_join(F.transform("_pages", lambda p: p["_text"]), "").alias(text))


def page_text(pages: DataFrame, number: int = 0, doc: str = "doc_id", page: str = "page_no", text: str = "text", strict: bool = False) -> DataFrame:
    """``doc`` and the text of its page ``number`` (from 0, by page number). A document without it has null, or raises an error if ``strict``."""
    at = F.max(F.when(F.col(page) == number, F.coalesce(text, F.lit("")))).alias(text)
    found = pages.groupBy(doc).agg(at)
    if strict:
        missing = F.raise_error(F.concat(F.lit(f"no page {number} in document "), F.col(doc).cast("string")))
        found = found.withColumn(text, F.coalesce(F.col(text), missing))
    return found


def text_file_name(file_name: str) -> Column:
    """Every ``.pdf`` in the name becomes ``.txt``."""
    return F.replace(F.col(file_name), F.lit(".pdf"), F.lit(".txt"))
