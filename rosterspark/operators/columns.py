"""Column-wise operators: names, casts, dropping, filling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import extract, strip
from rosterspark.sources.tables import column_names, parse_date


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df.columns))


def normalise_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: normalise_columns(df) for name, df in tables.items()}


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[(strip(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")) for c, t in df.dtypes])


def whole_number(c: Column) -> Column:
    """Text like 12 or 12.0 as an integer; null for anything else."""
    return c.cast("string").try_cast("double").try_cast("int")


def coerce_by_name(df: DataFrame) -> DataFrame:
    """Columns named like dates become dates, those named like years, months and days integers; the first rule that
    fits decides.  Columns that have such a type already stay."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        low = name.lower()
        if "date" in low:
            return c if kind in ("date", "timestamp") else parse_date(c)
        if any(part in low for part in ("year", "month", "_day")):
            return whole_number(c)
        return c

    return df.select(*[one(c, t).alias(c) for c, t in df.dtypes])


def coerce_dates(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that are there become dates."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: parse_date(F.col(f"`{n}`")) for n in names if kinds.get(n) == "string"})


def column_profile(df: DataFrame) -> DataFrame:
    """``column, rows, filled, varies``: how many rows there are and have a value, and whether two values differ (the
    extremes tell).  One aggregation over all columns, combined before the shuffle, with no distinct."""
    aggregates = []
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`") if df.schema[c].dataType.typeName() not in ("map", "variant") else F.to_json(f"`{c}`")
        aggregates += [F.count(value).alias(f"f{i}"), (F.min(value) != F.max(value)).alias(f"v{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates)
    each = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"f{i}").alias("filled"), F.coalesce(F.col(f"v{i}"), F.lit(False)).alias("varies"))
            for i, c in enumerate(df.columns)
        ]
    )
    return row.select(F.explode(each).alias("x")).select("x.*")


def uninformative(df: DataFrame) -> DataFrame:
    """``column, verdict``: ``all null``, ``constant`` (one value, no nulls), or ``keep``."""
    verdict = F.when(F.col("filled") == 0, "all null").when(~F.col("varies") & (F.col("filled") == F.col("rows")), "constant").otherwise("keep")
    return column_profile(df).select("column", verdict.alias("verdict"))


def drop_uninformative(df: DataFrame) -> DataFrame:
    """Without columns that are all null or the same everywhere."""
    gone = [r["column"] for r in uninformative(df).filter("verdict != 'keep'").collect()]
    return df.drop(*gone)


def drop_matching(df: DataFrame, pattern: str = r"nominees_[1-9]") -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def drop_columns(df: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def biography_url(nid: Column) -> Column:
    return F.concat(F.lit("http://www.fjc.gov/node/"), nid.cast("string").try_cast("double").try_cast("bigint").cast("string"))


def citation_number(citation: Column) -> Column:
    """The number of an undivided citation; null for parts."""
    return F.regexp_replace(citation, "PN", "").try_cast("int")


def seat_letters(seat: Column, action: Column) -> Column:
    """The first letters of a seat whose nomination was confirmed."""
    return F.when(action == "confirmed", extract(seat, "([A-Za-z]+)"))


def is_given(c: Column) -> Column:
    """Whether there is a value that is not empty."""
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def or_false(c: Column) -> Column:
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def correct(df: DataFrame, key: list[str], corrections: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """Values of ``corrections`` (by ``key``, one row each) in place of those of ``df``, without the rows in
    ``deletions``."""
    others = [c for c in corrections.columns if c not in key]
    fixed = corrections.select(*key, *[F.col(c).alias(f"__{c}") for c in others])
    out = df.join(fixed, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in others}).select(*df.columns)
    return out if deletions is None else out.join(deletions, deletions.columns, "left_anti")


def fill_categories(df: DataFrame, names: list[str]) -> DataFrame:
    """``unknown`` in the named columns where null; every other column that is no number becomes text."""
    numbers = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    others = {c: F.col(f"`{c}`").cast("string") for c, t in df.dtypes if t not in numbers and not t.startswith("decimal") and c not in names}
    return df.withColumns(others).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in names if c in df.columns})
