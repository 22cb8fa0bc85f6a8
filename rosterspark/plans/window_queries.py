"""Queries for timelines, deduplication, unions and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions import calendar
from rosterspark.functions.dims import PRESIDENTS
from rosterspark.operators import joins, timeline

from .registry import WITH, nominations, query, table

_PRES = "pres(number, s, e) AS (VALUES " + ", ".join(f"({n}, DATE '{a}', DATE '{b}')" for n, a, b, _, _ in PRESIDENTS) + ")"
#: Seats of which some are unknown and one has very many rows.
_LINES = "SELECT CASE WHEN l_suppkey % 10 = 3 THEN NULL WHEN l_suppkey % 7 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS commission_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS termination_date FROM {lineitem}"
_ORDER = "commission_date, l_linenumber, l_orderkey, termination_date"


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES, lineitem=table(spark, sf_dir, "lineitem"))
    return lines.select(F.col("l_suppkey").alias("seat_id"), F.col("l_orderkey").alias("nid"), "l_linenumber", "commission_date", "termination_date")


_TIMELINE = f"""SELECT l_suppkey AS seat_id, l_orderkey AS nid, l_linenumber, commission_date, termination_date,
  CASE WHEN termination_date > nx THEN nx ELSE termination_date END AS vacancy_date
  FROM (SELECT *, CASE WHEN l_suppkey IS NOT NULL THEN lead(commission_date) OVER (PARTITION BY l_suppkey ORDER BY commission_date, l_orderkey, l_linenumber, termination_date) END AS nx FROM ({_LINES.format(lineitem='lineitem')}))"""


@query(_TIMELINE)
def seat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each seat falls vacant."""
    return timeline.seat_timeline(_service(spark, sf_dir))


@query(f"SELECT seat_id, nid AS predecessor_nid, vacancy_date FROM ({_TIMELINE}) WHERE vacancy_date IS NOT NULL")
def seat_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.predecessors(timeline.seat_timeline(_service(spark, sf_dir)))


@query(
    f"""SELECT seat_id, nid, l_linenumber, gap_days, CASE WHEN gap_days < -30 THEN 'overlap' WHEN gap_days > 2 THEN 'gap' ELSE 'regular' END AS succession FROM (
    SELECT l_suppkey AS seat_id, l_orderkey AS nid, l_linenumber, CASE WHEN l_suppkey IS NOT NULL THEN date_diff('day', lag(termination_date) OVER (PARTITION BY l_suppkey ORDER BY commission_date, l_orderkey, l_linenumber), commission_date) END AS gap_days FROM ({_LINES.format(lineitem='lineitem')}))"""
)
def succession_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.succession(_service(spark, sf_dir), "seat_id", "commission_date", "termination_date", ["nid", "l_linenumber"], gap=2)
    return out.select("seat_id", "nid", "l_linenumber", F.col("gap_days").cast("bigint").alias("gap_days"), "succession")


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return timeline.keep_latest(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT payload, request, retrieval_date FROM (SELECT DISTINCT CAST(user_id AS STRING) AS payload, event_type AS request, ts AS retrieval_date FROM events) QUALIFY row_number() OVER (PARTITION BY payload, request ORDER BY retrieval_date DESC) = 1")
def latest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("payload"), F.col("event_type").alias("request"), F.col("ts").alias("retrieval_date"))
    return timeline.latest_payloads(events, "payload")


@query("SELECT nid, sequence, min(o_orderkey) AS o_orderkey FROM (SELECT o_custkey AS nid, CAST(year(o_orderdate) AS BIGINT) AS sequence, o_orderkey FROM orders) GROUP BY 1, 2")
def dedupe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nid"), F.year("o_orderdate").cast("bigint").alias("sequence"), "o_orderkey")
    return timeline.dedupe_history(rows, [F.col("o_orderkey")])


@query(
    """SELECT seat_id, source_year, source_month, n FROM (SELECT o_custkey AS seat_id, CAST(year(o_orderdate) AS BIGINT) AS source_year, CAST(month(o_orderdate) AS BIGINT) AS source_month, count(*) AS n FROM orders GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY seat_id ORDER BY source_year DESC, source_month DESC) = 1"""
)
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest monthly report of each seat."""
    monthly = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seat_id"), F.year("o_orderdate").alias("source_year"), F.month("o_orderdate").alias("source_month")).agg(F.count(F.lit(1)).alias("n"))
    out = timeline.latest_report_per_seat(monthly)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("source_year", "source_month")})


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 ORDER BY user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) LIMIT 20")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty repeated rows: the report has that many."""
    return timeline.duplicate_report(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, least(2, count(*)) AS n FROM events GROUP BY 1")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples of each type are drawn."""
    return timeline.sample_per_group(table(spark, sf_dir, "events"), "event_type", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 highest: a top-k report."""
    return timeline.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), 25, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT o_orderkey AS key, o_totalprice AS price, NULL::STRING AS name, 'orders' AS _dataset_source FROM orders UNION ALL SELECT p_partkey, p_retailprice, p_name, 'part' FROM part")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))
    return timeline.tagged_union({"orders": o, "part": p})


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, 0 AS t FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) = 1"""
)
def first_of_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderkey")
    return timeline.first_of_tiers([o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), rows], ["o_custkey"])


def _election(y: str) -> str:
    return f"(make_date({y}, 11, 1) + CAST((8 - isodow(make_date({y}, 11, 1))) % 7 AS INT) + 1)"


def _next(r: int) -> str:
    y = f"(year(d) + (({r} - year(d)) % 4 + 4) % 4)"
    return f"date_diff('day', d, CASE WHEN d > {_election(y)} THEN {_election('(' + y + ' + 4)')} ELSE {_election(y)} END)"


_TERM = "(CAST(floor(floor(date_diff('day', s, d) / 365.2425) / 4) AS INT) + 1)"


@query(
    f"""WITH {_PRES}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, {_next(0)} AS days_to_presidential, {_next(2)} AS days_to_midterm, {_TERM} AS term_index, {_TERM} - 1 AS later_terms,
    date_diff('day', CAST(s + to_months(48 * ({_TERM} - 1)) AS DATE), d) + 1 AS days_into_term,
    ((CASE WHEN year(d) % 2 = 1 THEN year(d) ELSE year(d) - 1 END) - 1789) // 2 + 1 AS congress, CASE WHEN year(d) % 2 = 1 THEN 1 ELSE 2 END AS session,
    CASE WHEN d < DATE '2013-11-21' THEN 'pre-2013' ELSE 'later' END AS era
    FROM o LEFT JOIN pres ON d >= s AND d < e"""
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elections, terms, congresses and eras of all order dates."""
    o = joins.president_at(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d")
    d, s = F.col("d"), F.col("pres_start")
    values = {
        "days_to_presidential": calendar.days_to_presidential_election(d),
        "days_to_midterm": calendar.days_to_midterm(d),
        "term_index": calendar.term_index(d, s),
        "later_terms": calendar.later_terms(d, s),
        "days_into_term": calendar.days_into_term(d, s),
        "congress": calendar.congress_number(d),
        "session": calendar.congress_session(d),
    }
    return o.select("o_orderkey", *[c.cast("bigint").alias(n) for n, c in values.items()], calendar.senate_era(d).alias("era"))


@query(
    WITH
    + """SELECT o_orderkey, date_diff('day', receiveddate, actiondate) AS days_to_action, CASE WHEN contains(lower(action), 'confirmed') THEN date_diff('day', receiveddate, actiondate) END AS days_to_confirmation,
    CASE WHEN date_diff('day', receiveddate, actiondate) < 30 THEN 'very fast' WHEN date_diff('day', receiveddate, actiondate) < 90 THEN 'fast' WHEN date_diff('day', receiveddate, actiondate) < 180 THEN 'moderate' ELSE 'slow' END AS speed,
    round(date_diff('day', receiveddate, actiondate) / 7.0::DOUBLE, 6) AS weeks, round(date_diff('day', receiveddate, actiondate) / 30.44::DOUBLE, 6) AS months FROM noms"""
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from nomination to action and to confirmation, in other units and as a class."""
    noms = nominations(spark, sf_dir)
    days = calendar.days_between(F.col("receiveddate"), F.col("actiondate"))
    return noms.select(
        "o_orderkey",
        days.cast("bigint").alias("days_to_action"),
        calendar.days_to_confirmation(F.col("receiveddate"), F.col("actiondate"), F.col("action")).cast("bigint").alias("days_to_confirmation"),
        calendar.speed_class(days).alias("speed"),
        F.round(calendar.weeks(days), 6).alias("weeks"),
        F.round(calendar.months(days), 6).alias("months"),
    )


@query(
    """SELECT c_custkey, coalesce(CASE WHEN m IS NOT NULL AND dd IS NOT NULL AND dd <= CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END AND m <= 12 THEN make_date(y, m, dd) END, make_date(y, 7, 1)) AS birth_date_approx_dt
    FROM (SELECT c_custkey, CAST(1890 + c_custkey % 90 AS INT) AS y, CAST(nullif(c_custkey % 14, 0) AS INT) AS m, CAST(nullif(c_custkey % 32, 0) AS INT) AS dd FROM customer)
    WHERE coalesce(CASE WHEN m IS NOT NULL AND dd IS NOT NULL AND dd <= CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END AND m <= 12 THEN make_date(y, m, dd) END, make_date(y, 7, 1)) >= DATE '1900-01-01'"""
)
def approximate_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth from parts, the implausible ones left out."""
    from rosterspark.operators.filters import plausible_birth

    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("cast(1890 + c_custkey % 90 as int)").alias("y"), F.expr("cast(nullif(c_custkey % 14, 0) as int)").alias("m"), F.expr("cast(nullif(c_custkey % 32, 0) as int)").alias("dd"))
    dated = c.select("c_custkey", calendar.approximate_birth(F.col("y"), F.col("m"), F.col("dd")).alias("birth_date_approx_dt"))
    return plausible_birth(dated)
