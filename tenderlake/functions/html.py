"""Links of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Anchors with a quoted reference; those of other forms need :func:`hrefs_parsed`.
ANCHOR = r'<a[^>]*href="([^"]*)"'


def hrefs(html: Column) -> Column:
    """The references of all anchors in document order, by an expression that stays in the JVM."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.array())


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = dict(attrs)
        if tag == "a" and "href" in held:
            self.found.append(held["href"] or "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def hrefs_parsed(html: pd.Series) -> pd.Series:
    """As :func:`hrefs` with a parser: any case, quotes and order of attributes, character references resolved."""

    def parse(page: str | None) -> list[str]:
        parser = _Anchors()
        parser.feed(page or "")
        parser.close()
        return parser.found

    return html.map(parse)
