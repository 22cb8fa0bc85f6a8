"""Matching records to persons, and nominations to seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions.names import split_name
from rosterspark.functions.text import crosswalk_predecessor, or_null, strip
from rosterspark.sources.tables import settle

from .ordered import ROWS, scanned


def with_split_names(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(split_name(F.col(column)))


def _named(df: DataFrame) -> DataFrame:
    """Rows with a first and a last name that are not empty."""
    return df.filter("first != '' and last != ''")


def name_profile(persons: DataFrame, person: str) -> DataFrame:
    """``last, first, least, most``: of each name the least and the greatest id of its persons; they are equal for a name
    of one person."""
    return _named(persons).groupBy("last", "first").agg(F.min(person).alias("least"), F.max(person).alias("most"))


def name_candidates(records: DataFrame, persons: DataFrame, record: str, person: str) -> DataFrame:
    """``record, least, most``: of all persons with a name of the record (columns ``first, last`` on both sides) the least
    and the greatest id.  A record meets one row for each of its names, however many persons have them."""
    names = _named(records).select(record, "last", "first").distinct()
    return names.join(name_profile(persons, person), ["last", "first"]).groupBy(record).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def by_date(records: DataFrame, persons: DataFrame, dates: DataFrame, record: str, person: str, date: str, window: int, rows_each: int = ROWS) -> DataFrame:
    """Of the persons with a name of the record the one with a date (long table ``person, nomination_date``) nearest to the
    record's ``date`` (of a repeated record its first), at most ``window`` days away; of equal ones the least id.

    Dates of persons and records of one name are put in one order; the last one before and the first one after are
    carried to each record.  So a name costs its persons' dates and its records, and no pairs are made."""
    when = _named(records).groupBy(record).agg(F.min(F.col(date).cast("date")).alias("__day"))
    asked = _named(records).select(record, "last", "first").distinct().join(when.filter("__day IS NOT NULL"), record)
    known_dates = dates.select(person, F.col("nomination_date").cast("date").alias("__day")).filter("__day IS NOT NULL")
    own = _named(persons).select(person, "last", "first").distinct().join(known_dates, person)
    held = own.groupBy("last", "first", "__day").agg(F.min(person).alias("__who"))
    kind = held.schema["__who"].dataType
    stamps = asked.select("last", "first", "__day").distinct().withColumns({"__who": F.lit(None).cast(kind), "__asked": F.lit(True)})
    every = held.withColumn("__asked", F.lit(False)).unionByName(stamps).withColumn("__n", F.unix_date("__day"))
    one = F.when(F.col("__who").isNotNull(), F.struct("__n", "__who"))
    names = asked.select("last", "first").unionAll(own.select("last", "first"))
    both = scanned(every, ["last", "first"], [F.col("__n"), F.col("__asked")], last={"__before": one}, coming={"__after": one}, rows_each=rows_each, rows_of=names, at_most=records.count() + dates.count())
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__n") - F.col(f"{c}.__n")).alias("gap"), F.col(f"{c}.__who").alias("who")))
    nearest = both.filter("__asked").select("last", "first", "__day", F.least(gap("__before"), gap("__after")).alias("__x")).filter(F.col("__x.gap") <= window)
    return asked.join(nearest, ["last", "first", "__day"]).groupBy(record).agg(F.min("__x").alias("x")).select(record, F.col("x.who").alias(person))


def by_middle_initial(records: DataFrame, persons: DataFrame, record: str, person: str) -> DataFrame:
    """Of the persons with a name of the record the one with the same, known middle initial; of several the least id."""
    columns = ["last", "first", "mi"]
    held = _named(persons).filter("mi != ''").groupBy(*columns).agg(F.min(person).alias("__who"))
    asked = _named(records).filter("mi != ''").select(record, *columns).distinct()
    return asked.join(held, columns).groupBy(record).agg(F.min("__who").alias(person))


def match_by_name_and_date(records: DataFrame, persons: DataFrame, dates: DataFrame, record: str = "citation", person: str = "nid", date: str = "receiveddate", window: int = 730, rows_each: int = ROWS) -> DataFrame:
    """``records`` with ``person`` and ``match_confidence``: ``high_unambiguous`` for a single candidate of the name,
    ``high_date_resolved`` for the nearest of several by date, ``medium_mi_resolved`` by middle initial, ``no_match``.

    ``records`` and ``persons`` carry ``first, last, mi``; the first tier that has an answer holds.  Null ids of persons
    are no candidates; a record without an id or a name has no match."""
    persons, ids = persons.filter(F.col(person).isNotNull()), records.filter(F.col(record).isNotNull())
    found = settle(name_candidates(ids, persons, record, person))  # every tier asks it
    single = found.filter("least = most").select(record, F.col("least").alias(person))
    many = ids.join(found.filter("least != most").select(record), record, "left_semi")
    dated = by_date(many, persons, dates, record, person, date, window, rows_each)
    initial = by_middle_initial(many, persons, record, person)
    best = first_tier([(single, 1, "high_unambiguous"), (dated, 2, "high_date_resolved"), (initial, 3, "medium_mi_resolved")], record, person)
    return records.join(best, record, "left").withColumn("match_confidence", F.coalesce("match_confidence", F.lit("no_match")))


def first_tier(tiers: list[tuple[DataFrame, int, str]], record: str, person: str) -> DataFrame:
    """The union of tiers; each record from the first that has it."""
    every = None
    for df, rank, label in tiers:
        one = df.select(record, F.struct(F.lit(rank).alias("rank"), F.col(person).alias("person"), F.lit(label).alias("label")).alias("x"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(record).agg(F.min("x").alias("x")).select(record, F.col("x.person").alias(person), F.col("x.label").alias("match_confidence"))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(strip(c), r"\s+"), -1)


def suffix_match(queries: DataFrame, query: str, names: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """``query, value``: for each different name asked for, ``value`` of the row of ``names`` with that very name (the
    last by ``order``), else of the first by ``order`` whose name ends with the last token asked for.

    Ends are compared by equality first: a name that ends with a token T has a suffix T, and every suffix of its last
    token, down to the length of the shortest token asked for, is a key; so the join is an equality and no product of
    the tables.  Tokens with blanks cannot occur."""
    asked = queries.select(query).filter(F.coalesce(F.col(query), F.lit("")) != "").distinct().withColumn("__token", last_token(F.col(query)))
    rows = names.select(F.col(name).alias("__name"), F.col(value).alias("__value"), F.col(order).alias("__order")).filter("__name != ''")
    exact = asked.join(rows, F.col(query) == F.col("__name")).groupBy(query).agg(F.max(F.struct("__order", "__value")).alias("x")).select(query, F.col("x.__value").alias("__exact"))
    token = last_token(F.col("__name"))
    least = F.greatest(F.length("__last") - asked.agg(F.coalesce(F.min(F.length("__token")), F.lit(1)).alias("n")).first()["n"] + 1, F.lit(1))
    # different last tokens are far fewer than rows
    tokens = rows.filter(F.length(token) > 0).groupBy(token.alias("__last")).agg(F.min(F.struct("__order", "__value")).alias("x"))
    last = F.col("__last")
    ends = tokens.select("x", F.explode(F.transform(F.sequence(F.lit(1), least), lambda i: F.substring(last, i, F.length(last)))).alias("__token"))
    firsts = ends.groupBy("__token").agg(F.min("x").alias("x")).select("__token", F.col("x.__value").alias("__loose"))
    found = asked.join(exact, query, "left").join(firsts, "__token", "left")
    return found.select(query, F.coalesce("__exact", "__loose").alias(value))


def crosswalk(nominations: DataFrame, timeline: DataFrame, judges: DataFrame, order: str = "nid") -> DataFrame:
    """Nominations with the seat that falls vacant: predecessor from the description, to a judge by
    :func:`suffix_match`, then to the timeline by the judge's seat if judges have one (``seat_id``), else, or where
    that seat is unknown, by the judge.  ``seat_match_method`` is ``predecessor_name`` or ``unmatched``.

    Each nomination has one key, its seat where the timeline has that, else its judge, and each row of the timeline is
    found under both; so it is one join, and no row needs a number."""
    noms = nominations.withColumn("predecessor_name", crosswalk_predecessor(F.col("description")))
    full = judges.withColumn("__full", F.concat_ws(" ", or_null(strip(F.col("first_name"))), or_null(strip(F.col("last_name")))))
    ids = suffix_match(noms, "predecessor_name", full, "__full", "nid", order).withColumnRenamed("nid", "predecessor_nid")
    out = noms.join(ids, "predecessor_name", "left")
    line = timeline.withColumnRenamed("nid", "timeline_nid")
    if "seat_id" in judges.columns:
        seats = judges.filter("seat_id is not null").groupBy(F.col("nid").alias("predecessor_nid")).agg(F.max("seat_id").alias("__seat"))
        there = line.filter("seat_id is not null").select(F.col("seat_id").alias("__seat")).distinct().withColumn("__there", F.lit(True))
        out = out.join(seats, "predecessor_nid", "left").join(there, "__seat", "left")
        by_seat = F.col("__there")
    else:
        out, by_seat = out.withColumn("__seat", F.lit(None).cast("string")), F.lit(False)
    own = F.when(by_seat, F.struct(F.lit("seat").alias("kind"), F.col("__seat").cast("string").alias("id"))).otherwise(F.struct(F.lit("judge").alias("kind"), F.col("predecessor_nid").cast("string").alias("id")))
    keys = F.array(F.struct(F.lit("seat").alias("kind"), F.col("seat_id").cast("string").alias("id")), F.struct(F.lit("judge").alias("kind"), F.col("timeline_nid").cast("string").alias("id")))
    keyed = line.withColumn("__key", F.explode(keys)).withColumns({"__kind": F.col("__key.kind"), "__id": F.col("__key.id")}).drop("__key")
    asked = out.withColumn("__own", own).withColumns({"__own_kind": F.col("__own.kind"), "__own_id": F.col("__own.id")}).drop("__own", "__seat", "__there")
    every = asked.join(keyed, (F.col("__own_kind") == F.col("__kind")) & (F.col("__own_id") == F.col("__id")), "left")
    method = F.when(F.col("timeline_nid").isNotNull(), "predecessor_name").otherwise("unmatched")
    return every.withColumn("seat_match_method", method).drop("__own_kind", "__own_id", "__kind", "__id")


def candidate_ranks(pairs: DataFrame, record: str, order: list[Column]) -> DataFrame:
    """Candidates numbered within their record."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(record).orderBy(*order)))
