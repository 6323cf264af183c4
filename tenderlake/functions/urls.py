"""URL and path functions. Built-in expressions where they suffice; dot segments go through a vectorised function."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basename(path: str | Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def url_path(url: str | Column) -> Column:
    """The path of a URL, percent signs kept; empty if there is none."""
    return F.coalesce(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("PATH")), F.lit(""))


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def join(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``, by the rules of relative references. Null if either is null, or if the pair can't be joined."""
    return _joined(base, href)


def resolve_simple(base: Column, href: Column) -> Column:
    """As :func:`resolve` for references without dot segments, in built-in expressions alone: absolute, ``//host/..``, ``/path``, or a name beside the page."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(folder, href))
    )


def prefixed(site: str, href: Column) -> Column:
    """The plain rule of the listing crawler: absolute links stay, others follow the site's address without a slash between."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))
