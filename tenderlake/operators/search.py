"""Keyword search: every term must stand in at least one of the fields, whatever its case."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r'"([^"]*)"|\'([^\']*)\'|([^\s,]+)')


def terms_of(query: str | None) -> list[str]:
    """The terms of a search: words between white space and commas; quoted phrases stay whole."""
    return [t for m in _TERM.finditer(query or "") if (t := next(x for x in m.groups() if x is not None))]


def matches(terms: Sequence[str], fields: Sequence[str | Column]) -> Column | None:
    """The predicate, or None without terms. A null field doesn't match. Case is folded as Unicode has it."""
    columns = [F.lower(F.col(f) if isinstance(f, str) else f) for f in fields]
    tests = [reduce(or_, (c.contains(t.lower()) for c in columns)) for t in terms]
    return reduce(and_, tests) if tests else None


def search(df: DataFrame, query: str | None, fields: Sequence[str | Column]) -> DataFrame:
    """The rows that match; all rows if the search is empty."""
    predicate = matches(terms_of(query), fields)
    return df if predicate is None else df.where(predicate)
