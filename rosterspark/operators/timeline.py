"""Windows, deduplication, timelines and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, scanned


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (give an order without ties); null keys are a key."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("__n = 1").drop("__n")


def latest_payloads(df: DataFrame, payload: str) -> DataFrame:
    """The newest retrieval of each payload and request (an unknown date counts as newest); of one date the first by all
    columns."""
    return keep_latest(df, [payload, "request"], [F.col("retrieval_date").desc_nulls_first(), *_rest(df, payload, "request", "retrieval_date")])


def _rest(df: DataFrame, *but: str) -> list[Column]:
    """All other columns, to order rows that are equal so far."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def duplicate_report(df: DataFrame, keys: list[str], order: list[Column], most: int = 20) -> DataFrame:
    """Rows after the first of each key, sorted by key, ``order`` and all columns, at most ``most``; null keys are a key.

    Keys that repeat are counted, and the first ``most`` of them are enough.  Of their rows the first ``2 most + 1`` in
    order hold at least ``most`` that are not the first of their key: each task keeps so many, and no key meets in one."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").orderBy(*keys).limit(most).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    own = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    rows = df.join(F.broadcast(again), own, "left_semi")  # at most `most` keys
    order = [*order, *_rest(df, *keys)]
    head = rows.orderBy(*keys, *order).limit(2 * most + 1)
    numbered = head.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("__n > 1").orderBy(*keys, "__n").limit(most).drop("__n")


def dedupe_history(df: DataFrame, order: list[Column]) -> DataFrame:
    return keep_latest(df, ["nid", "sequence"], order)


def latest_report_per_seat(df: DataFrame, seat: str = "seat_id") -> DataFrame:
    """The row of the newest report (``source_year, source_month``) of each seat; a month that is none comes last.  Of one
    month the first by all columns."""
    sound = F.col("source_month").between(1, 12) & F.col("source_year").isNotNull()
    return keep_latest(df, [seat], [F.when(sound, F.col("source_year") * 12 + F.col("source_month")).desc_nulls_last(), *_rest(df, seat)])


def seat_timeline(service: DataFrame, seat: str = "seat_id", strip_succession: bool = False, rows_each: int = ROWS) -> DataFrame:
    """``service`` with ``vacancy_date``: the termination, or the successor's commission where that comes first.

    Rows of a seat are ordered by commission (unknown last).  With ``strip_succession`` seats are told apart without
    the last two digits of their id.  Rows without a seat have no successor and don't meet; a seat of over ``rows_each``
    rows is scanned in ranges."""
    missing = [c for c in (seat, "commission_date", "termination_date") if c not in service.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    key = F.regexp_replace(F.col(seat).cast("string"), r"\d{2}$", "") if strip_succession else F.col(seat)
    order = [F.col("commission_date").isNull(), F.col("commission_date"), *_rest(service, seat, "commission_date")]
    rows = scanned(service.withColumn("__seat", key), ["__seat"], order, after={"__next": F.col("commission_date")}, rows_each=rows_each)
    vacancy = F.when(F.col("termination_date") > F.col("__next"), F.col("__next")).otherwise(F.col("termination_date"))
    return rows.withColumn("vacancy_date", vacancy).drop("__seat", "__next")


def predecessors(timeline: DataFrame) -> DataFrame:
    return timeline.filter("vacancy_date is not null").select("seat_id", F.col("nid").alias("predecessor_nid"), "vacancy_date")


def succession(service: DataFrame, seat: str, start: str, end: str, tie: list[str], overlap: int = -30, gap: int = 1460, rows_each: int = ROWS) -> DataFrame:
    """Days between the previous row's end and this one's start within a seat, and whether that is an overlap or gap.  The
    first of a seat and rows without a seat have no such days and are regular.  Rows go by ``start`` and ``tie`` (unknown
    ones last), then by ``end`` and all columns."""
    by = dict.fromkeys([start, *tie, end])
    order = [o for c in by for o in (F.col(c).isNull(), F.col(c))] + _rest(service, seat, *by)
    rows = scanned(service, [seat], order, before={"__end": F.col(end)}, rows_each=rows_each)
    out = rows.withColumn("gap_days", F.datediff(F.col(start), F.col("__end"))).drop("__end")
    return out.withColumn("succession", F.when(F.col("gap_days") < overlap, "overlap").when(F.col("gap_days") > gap, "gap").otherwise("regular"))


def top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_per_group(df: DataFrame, group: str, key: str, k: int = 2, seed: int = 42) -> DataFrame:
    """``k`` rows of each group, chosen by a hash of the key."""
    over = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__n", F.row_number().over(over)).filter(F.col("__n") <= k).drop("__n")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def tagged_union(tables: dict[str, DataFrame], column: str = "_dataset_source") -> DataFrame:
    return union_all([df.withColumn(column, F.lit(name)) for name, df in tables.items()])


def first_of_tiers(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the first table that has a key; ties within a table by all columns."""
    ranked = union_all([df.withColumn("__tier", F.lit(i)) for i, df in enumerate(tables)])
    rest = [F.col(c) for c in ranked.columns if c not in keys and c != "__tier"]
    return keep_latest(ranked, keys, [F.col("__tier"), *rest]).drop("__tier")
