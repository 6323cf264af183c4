"""Ordering by request: ``a,-b`` with a white list, a default and a tie-breaker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def order_columns(ordering: str | None, allowed: Sequence[str], default: str | None = None, tie: Sequence[str] = ("id",)) -> list[Column]:
    """Names that aren't allowed are dropped; if none is left the default holds. Null comes first ascending and last descending; ties go by ``tie``."""
    chosen = [x for x in _names(ordering) if x.lstrip("-") in allowed] or _names(default)
    columns = [F.col(x[1:]).desc_nulls_last() if x[0] == "-" else F.col(x).asc_nulls_first() for x in chosen]
    return columns + [F.col(x).asc_nulls_first() for x in tie if x not in {c.lstrip("-") for c in chosen}]


def order(df: DataFrame, ordering: str | None, allowed: Sequence[str], default: str | None = None, tie: Sequence[str] = ("id",)) -> DataFrame:
    """A total order over all rows: a range shuffle, so the result's partitions follow each other."""
    return df.orderBy(*order_columns(ordering, allowed, default, tie))
