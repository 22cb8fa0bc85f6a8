"""Profiles and checks of data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import column_profile


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of values that occur more than once; nulls are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    return df.join(duplicate_ids(df, key), key, "left_semi")


def id_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: ``is_unique, duplicate_count``; a table without the column is unique."""
    if key not in df.columns:
        return df.sparkSession.range(1).select(F.lit(True).alias("is_unique"), F.lit(0).cast("bigint").alias("duplicate_count"))
    counted = duplicate_ids(df, key).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return counted.select((F.col("duplicate_count") == 0).alias("is_unique"), "duplicate_count")


def validate_catalog(tables: dict[str, DataFrame], keys: tuple[str, ...] = ("nid", "citation")) -> DataFrame:
    """``table, key, is_unique, duplicate_count`` by the first of ``keys`` a table has; tables with none are left out."""
    out = None
    for name, df in tables.items():
        key = next((k for k in keys if k in df.columns), None)
        if key:
            one = id_uniqueness(df, key).select(F.lit(name).alias("table"), F.lit(key).alias("key"), "is_unique", "duplicate_count")
            out = one if out is None else out.unionByName(one)
    return out


def schema_comparison(new: DataFrame, old: DataFrame, critical: tuple[str, ...] = ()) -> dict[str, object]:
    """Names in both, missing from the new, and extra; share of the old ones covered, in percent; and a score, which
    each critical column of the old table that the new one lacks lowers by a fifth."""
    a, b = set(new.columns), set(old.columns)
    covered = len(a & b) / len(b) if b else 0.0
    lacking = sum(c in b and c not in a for c in critical)
    return {"common": sorted(a & b), "missing": sorted(b - a), "extra": sorted(a - b), "coverage": round(100 * covered, 2), "score": round(100 * max(0.0, covered - 0.2 * lacking), 2)}


def field_comparison(new: DataFrame, old: DataFrame, critical: tuple[str, ...] = (), warn_above: float = 50.0) -> DataFrame:
    """A row for each column of either table: ``column, status`` (common, missing from the new, extra), ``critical``,
    ``null_percent`` in the new table (null where it lacks the column) and ``mostly_null``.  One aggregation."""
    profile = null_profile(new, warn_above)
    old_names = old.columns
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in old_names).alias("was")) for c in dict.fromkeys([*new.columns, *old_names])]))
    fields = new.sparkSession.range(1).select(every.alias("x")).select("x.*")
    out = fields.join(profile, "column", "left")
    status = F.when(F.col("nulls").isNull(), "missing").when(F.col("was"), "common").otherwise("extra")
    wanted = F.col("column").isin(list(critical)) if critical else F.lit(False)
    return out.select("column", status.alias("status"), wanted.alias("critical"), "null_percent", F.coalesce("mostly_null", F.lit(False)).alias("mostly_null"))


def null_profile(df: DataFrame, warn_above: float = 50.0) -> DataFrame:
    """``column, nulls, null_percent, mostly_null``: one aggregation.  Of no rows no share is null (0)."""
    profile = column_profile(df)
    share = F.round(F.coalesce(F.try_divide(100 * (F.col("rows") - F.col("filled")), F.col("rows")), F.lit(0.0)), 2)
    return profile.select("column", (F.col("rows") - F.col("filled")).alias("nulls"), share.alias("null_percent"), (share > warn_above).alias("mostly_null"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, filled, rate``: how often the columns have a value; without rows the rate is null."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"f_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f_{c}").alias("filled"), F.round(F.try_divide(f"f_{c}", "n"), 6).alias("rate")) for c in columns])
    return row.select(F.explode(each).alias("x")).select("x.*")


def missing_rates(df: DataFrame, columns: list[str], distinct: str) -> DataFrame:
    """One row: share of rows without each of the columns, and number of different values of one."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.agg(*[F.round(F.avg(blank(c).cast("double")), 6).alias(f"missing_{c}") for c in columns], F.count_distinct(distinct).alias(f"distinct_{distinct}"))


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, first, last, n``."""
    row = df.agg(*[f(F.col(c).cast("date")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("first"), F.col(f"hi_{c}").alias("last"), F.col(f"n_{c}").alias("n")) for c in columns])
    return row.select(F.explode(each).alias("x")).select("x.*")


def monthly_series(df: DataFrame, date: str) -> DataFrame:
    """``month, n`` for every month between the first and the last, also those with none."""
    months = df.filter(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    spine = months.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(months, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def low_cardinality(df: DataFrame, below: int = 20) -> DataFrame:
    """``column, value, n`` of string columns with fewer different values than ``below``.  Estimated numbers of values
    say which columns are counted at all, so only those that may have few are taken value by value."""
    strings = [c for c, t in df.dtypes if t == "string"]
    guess = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"k{i}") for i, c in enumerate(strings)]).first() if strings else ()
    few = [c for c, k in zip(strings, guess) if k <= 1.5 * below]
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in few])
    counts = df.select(F.explode(each).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("column").agg(F.count("value").alias("kinds")).filter(F.col("kinds") < below).select("column")
    return counts.join(kinds, "column", "left_semi")
