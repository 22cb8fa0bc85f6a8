"""Joins: as of a date, by interval, with renaming, by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions import calendar
from rosterspark.functions.dims import control, presidents
from rosterspark.functions.text import first_year

from .ordered import ROWS, known, scanned


def _joined_back(left: DataFrame, found: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of ``found``, which has a row for each of its (keys, time).  Rows whose key or time is null
    match nothing and are dealt out by number, so that they don't meet."""
    alone = F.when(known([*keys, time]), 0).otherwise(1 + F.monotonically_increasing_id() % 4096)
    # 0 for all, but no constant, which the join would not be dealt by
    there = found.withColumn("__alone", F.pmod(F.xxhash64(*keys), F.lit(1)))
    return left.withColumn("__alone", alone).join(there, [*keys, time, "__alone"], "left").select(*left.columns, *columns)


def _every(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).unionAll(right.select(*keys))


def asof_best(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: Column, rank: list[Column], columns: dict[str, str], rows_each: int = ROWS) -> DataFrame:
    """``left`` with ``columns`` (old name to new) of a row of ``right``: of those with equal ``keys`` and ``right_time``
    up to ``left_time`` the least by ``rank`` (columns of ``right``).  Null keys and times match nothing, no row of
    ``left`` is lost, and rows of equal rank are told apart by their values.

    No pairs are made: both sides are put in one order by time within the key, the least so far is carried on, and a
    key costs its number of rows, in ranges of time where it has over ``rows_each``.  Of ``left`` only the different
    (keys, time) take part, of ``right`` only the best of each (keys, time), combined before the shuffle; what is found
    is joined back by (keys, time)."""
    value = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    best = right.filter(known(keys) & right_time.isNotNull()).groupBy(*keys, right_time.alias("__t")).agg(F.min(value).alias("__v"))
    stamps = left.filter(known([*keys, left_time])).select(*keys, F.col(left_time).alias("__t")).distinct()
    every = best.withColumn("__asked", F.lit(False)).unionByName(stamps.withColumns({"__v": F.lit(None).cast(best.schema["__v"].dataType), "__asked": F.lit(True)}))
    carried = scanned(every, keys, [F.col("__t"), F.col("__asked")], least={"__best": F.col("__v")}, rows_each=rows_each, rows_of=_every(left, right, keys))
    found = carried.filter("__asked").select(*keys, F.col("__t").alias(left_time), *[F.col(f"__best.v{i}").alias(new) for i, new in enumerate(columns.values())])
    return _joined_back(left, found, keys, left_time, list(columns.values()))


def _descending(c: Column) -> list[Column]:
    """Greater first, null before all: to be used where least wins."""
    return [c.isNotNull(), -c]


def _by_year(nominations: DataFrame, history: DataFrame, year: Column, rank: list[Column], columns: dict[str, str]) -> DataFrame:
    """:func:`asof_best` up to the year of ``receiveddate``."""
    dated = nominations.withColumn("__year", F.year("receiveddate"))
    return asof_best(dated, history, ["nid"], "__year", year, rank, columns).drop("__year")


def latest_education(nominations: DataFrame, education: DataFrame) -> DataFrame:
    """The last degree up to the year of ``receiveddate``: latest year, then highest sequence (an unknown one first)."""
    rank = [-F.col("degree_year"), *_descending(F.col("sequence"))]
    return _by_year(nominations, education, F.col("degree_year").cast("int"), rank, {"degree": "degree", "school": "school", "degree_year": "degree_year", "sequence": "education_sequence"})


def latest_career(nominations: DataFrame, career: DataFrame) -> DataFrame:
    """The career entry of the highest sequence (an unknown one first) that began by the year of ``receiveddate``."""
    columns = {"professional_career": "latest_career", "sequence": "career_sequence"}
    return _by_year(nominations, career, first_year(F.col("professional_career")).cast("int"), _descending(F.col("sequence")), columns)


def nearest_service(nominations: DataFrame, service: DataFrame, columns: list[str]) -> DataFrame:
    """The service whose nomination date is nearest before ``receiveddate``; then the lowest sequence (unknown last)."""
    day = F.col("nomination_date").cast("date")
    rank = [-F.unix_date(day), F.col("sequence").isNull(), F.col("sequence")]
    return asof_best(nominations, service, ["nid"], "receiveddate", day, rank, {c: f"fed_service_{c}" for c in columns})


def interval_lookup(df: DataFrame, date: str, dim: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with ``columns`` (old name to new) of the row of ``dim`` with start <= date < end; null out of range.

    ``dim`` must be a fixed table (here at most 34 rows): it is sent to all tasks."""
    small = F.broadcast(dim.select(F.col("start").alias("__start"), F.col("end").alias("__end"), *[F.col(c).alias(n) for c, n in columns.items()]))
    day = F.col(date).cast("date")
    return df.join(small, (day >= F.col("__start")) & (day < F.col("__end")), "left").drop("__start", "__end")


def president_at(df: DataFrame, date: str, prefix: str = "pres_") -> DataFrame:
    """Number, start, party and name of who was president."""
    return interval_lookup(df, date, presidents(df.sparkSession), {c: prefix + c for c in ("number", "start", "party", "name")})


def chambers_at(df: DataFrame, date: str, house: str = "house_party", senate: str = "senate_party") -> DataFrame:
    return interval_lookup(df, date, control(df.sparkSession), {"house": house, "senate": senate})


def alignment_flags(df: DataFrame, president: str, nomination: str, action: str) -> DataFrame:
    """Four flags at the date of nomination (``_at_nom``) and of the action (``_at_act``)."""
    for date, at in ((nomination, "_at_nom"), (action, "_at_act")):
        df = chambers_at(df, date, "__house", "__senate")
        flags = calendar.alignment(F.col(president), F.col("__house"), F.col("__senate"))
        df = df.withColumns({name + at: c for name, c in flags.items()}).drop("__house", "__senate")
    return df


def fill_president(df: DataFrame, date: str = "receiveddate", name: str = "appointing_president", party: str = "party_of_appointing_president") -> DataFrame:
    """Who was president, and of what party, where that is null and the date is known."""
    have = df if party in df.columns else df.withColumn(party, F.lit(None).cast("string"))
    found = interval_lookup(have, date, presidents(df.sparkSession), {"name": "__name", "party": "__party"})
    return found.withColumns({name: F.coalesce(name, "__name"), party: F.coalesce(party, "__party")}).drop("__name", "__party")


def join_with_suffixes(left: DataFrame, right: DataFrame, left_on: str, right_on: str, suffixes: tuple[str, str], how: str = "left") -> DataFrame:
    """A join in which columns of both sides with the same name get the suffixes (the key of equal name stays one)."""
    for side, key in ((left, left_on), (right, right_on)):
        if key not in side.columns:
            raise ValueError(f"no column {key}")
    same = left_on == right_on
    both = {c for c in left.columns if c in right.columns and not (same and c == left_on)}
    a = left.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in both else c) for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(c + suffixes[1] if c in both else ("__key" if same and c == right_on else c)) for c in right.columns])
    lk, rk = left_on + suffixes[0] if left_on in both else left_on, "__key" if same else right_on + suffixes[1] if right_on in both else right_on
    return a.join(b, F.col(f"`{lk}`") == F.col(f"`{rk}`"), how).drop("__key")


def nominees_with_nominations(nominees: DataFrame, nominations: DataFrame, key: str = "citation") -> DataFrame:
    return join_with_suffixes(nominees, nominations, key, key, ("_nominee", "_nomination"))


def nominees_onto_nominations(nominations: DataFrame, nominees: DataFrame, url: str = "nominees_0_url") -> DataFrame:
    """Each nomination with the nominee whose ``request`` has its URL; unchanged if a side lacks these columns."""
    if url not in nominations.columns or "request" not in nominees.columns:
        return nominations
    keyed = nominees.withColumn("__url", F.get_json_object("request", "$.url")).drop("request")
    return join_with_suffixes(nominations, keyed, url, "__url", ("", "_nominee")).drop("__url")


def with_demographics(df: DataFrame, demographics: DataFrame, key: str = "nid") -> DataFrame:
    return join_with_suffixes(df, demographics, key, key, ("", "_fjcdemographics"))


def master_dataset(timeline: DataFrame, nominations: DataFrame | None = None) -> DataFrame:
    """Seats with their nominations by seat_id; a court column of the nominations is left out."""
    return timeline if nominations is None else join_with_suffixes(timeline, nominations.drop("court"), "seat_id", "seat_id", ("_x", "_y"))


def priority_merge(tables: list[DataFrame], key: str) -> DataFrame:
    """One row per key: the first value that is not null, tables in order (within one table the least).  Rows without a
    key stay as they are.  A union and one grouped aggregate, combined before the shuffle."""
    columns = list(dict.fromkeys(c for t in tables for c in t.columns if c != key))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("__at", F.lit(i)) for i, t in enumerate(tables)))
    first = lambda c: F.min(F.when(F.col(f"`{c}`").isNotNull(), F.struct("__at", F.col(f"`{c}`").alias("v"))))
    merged = every.filter(F.col(key).isNotNull()).groupBy(key).agg(*[first(c).getField("v").alias(c) for c in columns])
    return merged.unionByName(every.filter(F.col(key).isNull()).select(key, *columns))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str, columns: dict[str, str], strict: bool = False, rows_each: int = ROWS) -> DataFrame:
    """``left`` with ``columns`` (old name to new) of the last row of ``right`` (by ``right_time``, then ``tie``, then these
    columns) with equal ``keys`` up to ``left_time`` (before it if ``strict``).  As :func:`asof_best`, but the last row is
    carried on and not the least."""
    value = F.struct(F.col(f"`{tie}`").alias("r"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    best = right.filter(known([*keys, right_time])).groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max(value).alias("__v"))
    stamps = left.filter(known([*keys, left_time])).select(*keys, F.col(left_time).alias("__t")).distinct()
    asked = stamps.withColumns({"__v": F.lit(None).cast(best.schema["__v"].dataType), "__side": F.lit(0 if strict else 2)})
    every = best.withColumn("__side", F.lit(1)).unionByName(asked)
    carried = scanned(every, keys, [F.col("__t"), F.col("__side")], last={"__last": F.col("__v")}, rows_each=rows_each, rows_of=_every(left, right, keys))
    found = carried.filter("__side != 1").select(*keys, F.col("__t").alias(left_time), *[F.col(f"__last.v{i}").alias(new) for i, new in enumerate(columns.values())])
    return _joined_back(left, found, keys, left_time, list(columns.values()))
