"""Deletions with their consequences, and reports of rule violations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.schemas import CASCADE, TABLES, Table

#: Shapes of values; the whole value has to match.
FORMS = {
    "email": r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$",
    "url": r"^(?:https?|ftps?)://[^\s/?#:]+(?::[0-9]{2,5})?(?:[/?#]\S*)?$",
}


def delete(tables: Mapping[str, DataFrame], name: str, keys: DataFrame, metadata: Mapping[str, Table] = TABLES) -> dict[str, DataFrame]:
    """All tables after the rows of ``name`` with ``keys`` (one column) are gone and every reference has been followed.

    Cascades go down level by level; references that are set to null keep their rows. Everything is one plan of semi and anti joins; a table without a reference to
    a deleted one is returned as it is.
    """
    gone = {name: keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()}
    out = dict(tables)
    # References lead from child to parent without a circle: a table is settled once all its parents are.
    left = [t for t in metadata.values() if t.name in tables]
    settled: set[str] = set()
    while left:
        table = next(t for t in left if all(r.target in settled or r.target not in tables for r in t.references))
        left.remove(table)
        settled.add(table.name)
        df = tables[table.name]
        found = [gone[table.name]] if table.name in gone else []
        for r in table.references:
            if r.target in gone and r.on_delete == CASCADE:
                found.append(df.join(gone[r.target], F.col(r.column) == F.col("_gone"), "left_semi").select(F.col(table.key).alias("_gone")))
        if found:
            gone[table.name] = reduce(DataFrame.unionByName, found).distinct()
            df = df.join(gone[table.name], F.col(table.key) == F.col("_gone"), "left_anti")
        for r in table.references:
            if r.target in gone and r.on_delete != CASCADE:
                df = null_out(df, r.column, gone[r.target])
        out[table.name] = df
    return out


def null_out(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``df`` with null in ``column`` where ``gone`` (one column of distinct keys) holds its value."""
    side = gone.select(F.col(gone.columns[0]).alias("_lost"))
    joined = df.join(side, df[column] == F.col("_lost"), "left")
    return joined.select(*(F.when(F.col("_lost").isNull(), df[c]).alias(c) if c == column else df[c] for c in df.columns))


def _report(rows: DataFrame, key: str, rule: str, field: str, value: Column | None = None) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("row_key"), F.lit(rule).alias("rule"), F.lit(field).alias("field"), (F.col(field) if value is None else value).cast("string").alias("value"))


def unique_violations(df: DataFrame, field: str, key: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows whose value occurs more than once in ``df``, or in ``existing``. Null violates nothing."""
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("_value")).agg(F.count("*").alias("_n"))
    doubled = counts.where("_n > 1").select("_value")
    if existing is not None:
        doubled = doubled.union(existing.select(F.col(field).alias("_value")).where("_value IS NOT NULL")).distinct()
    return _report(df.join(doubled, F.col(field) == F.col("_value"), "left_semi"), key, "unique", field)


def too_long(field: str, most: int) -> Column:
    return F.char_length(field) > most


def missing(field: str) -> Column:
    return F.col(field).isNull()


def ill_formed(field: str, form: str) -> Column:
    return (F.col(field) != "") & ~F.col(field).rlike(FORMS[form])


def no_decimal(field: str, digits: int = 15, places: int = 2) -> Column:
    """Whether a value (text or number) isn't a decimal of that size, or would be rounded."""
    text = F.col(field).cast("string")
    exact = text.try_cast(f"decimal({digits},{places})")
    return text.isNotNull() & (exact.isNull() | (exact != text.try_cast("decimal(38,10)")))


def length_violations(df: DataFrame, field: str, key: str, most: int) -> DataFrame:
    return _report(df.where(too_long(field, most)), key, "max_length", field)


def missing_violations(df: DataFrame, field: str, key: str) -> DataFrame:
    return _report(df.where(missing(field)), key, "required", field)


def reference_violations(df: DataFrame, field: str, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; null is no reference."""
    side = target.select(F.col(target_key).alias("_target"))
    return _report(df.where(F.col(field).isNotNull()).join(side, F.col(field) == F.col("_target"), "left_anti"), key, "reference", field)


def form_violations(df: DataFrame, field: str, key: str, form: str) -> DataFrame:
    return _report(df.where(ill_formed(field, form)), key, form, field)


def decimal_violations(df: DataFrame, field: str, key: str, digits: int = 15, places: int = 2) -> DataFrame:
    return _report(df.where(no_decimal(field, digits, places)), key, "decimal", field)


def equality_violations(df: DataFrame, field: str, other: str, key: str) -> DataFrame:
    """Rows whose two fields differ (null differs from all but null)."""
    return _report(df.where(~F.col(field).eqNullSafe(F.col(other))), key, f"equals {other}", field)


def normal_email(column: str) -> Column:
    """The part behind the last ``@`` in lower case."""
    c = F.col(column)
    domain = F.substring_index(c, "@", -1)
    return F.when(c.contains("@"), F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(domain)), F.lower(domain))).otherwise(c)


def row_violations(table: Table, rows: DataFrame, key: str) -> DataFrame:
    """Violations that a row shows by itself (required, length, form, decimal), all rules in one pass over the rows."""
    found = []
    for c in (c for c in table.columns if c.name in rows.columns):
        rules = [("required", missing(c.name))] if not c.nullable else []
        rules += [("max_length", too_long(c.name, c.max_length))] if c.max_length else []
        rules += [(c.form, ill_formed(c.name, c.form))] if c.form else []
        rules += [("decimal", no_decimal(c.name))] if c.kind == "money" else []
        entry = lambda rule: F.struct(F.lit(rule).alias("rule"), F.lit(c.name).alias("field"), F.col(c.name).cast("string").alias("value"))  # noqa: B023, E731
        found += [F.when(broken, entry(rule)) for rule, broken in rules]
    listed = F.array_compact(F.array(*found)) if found else F.lit(None).cast("array<struct<rule: string, field: string, value: string>>")
    return rows.select(F.col(key).cast("string").alias("row_key"), F.explode(listed).alias("_v")).select("row_key", "_v.*")


def validate(name: str, rows: DataFrame, tables: Mapping[str, DataFrame], metadata: Mapping[str, Table] = TABLES, key: str | None = None, unique: bool = True) -> DataFrame:
    """Every violation of ``rows`` to be inserted in table ``name``: ``row_key, rule, field, value``. ``key``: the column that names a row, if not the table's."""
    table = metadata[name]
    key = key or table.key
    reports = [row_violations(table, rows, key)]
    if unique:
        reports += [unique_violations(rows, c.name, key, tables.get(name)) for c in table.columns if c.unique and c.name in rows.columns]
    for r in table.references:
        if r.column in rows.columns and r.target in tables:
            reports.append(reference_violations(rows, r.column, key, tables[r.target], metadata[r.target].key))
    return reduce(DataFrame.unionByName, reports)
