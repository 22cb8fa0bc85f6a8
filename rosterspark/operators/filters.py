"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.dims import NON_JUDICIAL_TITLES
from rosterspark.functions.text import likely_judicial, valid_court


def drop_non_judicial(df: DataFrame, column: str = "description") -> DataFrame:
    """Without rows whose text has one of the titles, in that case of letters; null stays."""
    return df.filter(~F.coalesce(F.col(column).rlike("|".join(NON_JUDICIAL_TITLES)), F.lit(False)))


def drop_dash_zero(df: DataFrame, column: str = "citation") -> DataFrame:
    """Without citations that end in -0; null stays."""
    return df.filter(~F.coalesce(F.col(column).endswith("-0"), F.lit(False)))


def only_likely_judicial(df: DataFrame, column: str = "description") -> DataFrame:
    return df.filter(likely_judicial(F.col(column)))


def drop_true(df: DataFrame, column: str = "isprivileged") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).try_cast("boolean"), F.lit(False)))


def drop_supreme(df: DataFrame, column: str = "seat_level") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit("")) != "supreme")


def plausible_birth(df: DataFrame, column: str = "birth_date_approx_dt") -> DataFrame:
    """Born in 1900 or later; null goes."""
    return df.filter(F.col(column) >= F.lit("1900-01-01").cast("date"))


def oldest_years(df: DataFrame, before: int = 1980) -> DataFrame:
    """``column, year``: date columns with a year under ``before``, oldest first."""
    dates = [c for c, t in df.dtypes if t in ("date", "timestamp")]
    if not dates:
        return df.sparkSession.createDataFrame([], "column string, year int")
    row = df.agg(*[F.min(F.year(F.col(f"`{c}`"))).alias(f"y{i}") for i, c in enumerate(dates)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"y{i}").alias("year")) for i, c in enumerate(dates)])
    return row.select(F.explode(each).alias("x")).select("x.*").filter(F.col("year") < before).orderBy("year", "column")


def drop_impossible(matches: DataFrame, records: DataFrame, persons: DataFrame, record: str = "citation", person: str = "nid", date: str = "receiveddate", death: str = "death_year") -> DataFrame:
    """Without matches of a person who died in a year before that of the record; unknown years stay.  Of a repeated
    record the first year counts, of a repeated person the last."""
    years = records.groupBy(record).agg(F.min(F.year(date)).alias("__year"))
    deaths = persons.groupBy(person).agg(F.max(death).alias("__death"))
    joined = matches.join(years, record, "left").join(deaths, person, "left")
    return joined.filter("__death is null or __year is null or __death >= __year").select(*matches.columns)


def with_target(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def odd_organisation(description: Column, organization: Column) -> Column:
    """Speaks of a judge, but of neither Judiciary nor Court."""
    judge = F.coalesce(description.rlike("(?i)judge"), F.lit(False))
    return judge & ~F.coalesce(organization.rlike("(?i)judiciary|court"), F.lit(False))


def us_date(c: Column) -> Column:
    """Whether the text is MM/DD/YYYY with month 1 to 12, day 1 to 31 and year 1900 to 2100."""
    part = lambda at, n: F.substring(c, at, n).try_cast("int")
    sound = c.rlike(r"^\d\d/\d\d/\d{4}$") & part(1, 2).between(1, 12) & part(4, 2).between(1, 31) & part(7, 4).between(1900, 2100)
    return F.coalesce(sound, F.lit(False))


def only_valid_courts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(valid_court(F.col(column)))
