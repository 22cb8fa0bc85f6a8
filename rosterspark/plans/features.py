"""The whole way from nominations and histories to model features.  Descriptions are parsed into a table at once; from
there it is one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions import calendar, description, text
from rosterspark.operators import columns, filters, joins
from rosterspark.sources.tables import settle, spread

from .join_queries import _CTRL, _PRES
from .registry import DESCRIBED, nominations, query, table
from .window_queries import _TERM, _next


def build_features(noms: DataFrame, education: DataFrame, career: DataFrame, service: DataFrame, demographics: DataFrame) -> DataFrame:
    """Features of judicial nominations.

    ``noms``: citation, nid, description, receiveddate, latestaction_text, latestaction_actiondate, isprivileged;
    the histories by ``nid``.  Filters come first, so joins see only what stays; dimensions are fixed tables."""
    judicial = filters.drop_true(filters.drop_dash_zero(filters.drop_non_judicial(noms)))
    # Parsed once and kept: filters on what was parsed would otherwise carry all patterns below the joins.
    parsed = settle(description.parse_descriptions(columns.trim_strings(judicial)))
    parsed = parsed.withColumns(text.latest_action(F.col("latestaction_text")))
    level = text.seat_level(F.concat_ws(" ", "nomination_to_position_title", "nomination_to_court_name"))
    seats = filters.drop_supreme(parsed.withColumn("seat_level", level))
    known = joins.with_demographics(seats, demographics)
    schooled = joins.latest_career(joins.latest_education(known, education), career)
    served = joins.nearest_service(schooled, service, ["termination", "sequence"])
    ruled = joins.president_at(served.withColumn("highest_degree_level", text.degree_level(F.col("degree"))), "receiveddate")
    flagged = joins.alignment_flags(ruled, "pres_party", "receiveddate", "latestaction_actiondate")
    received, start = F.col("receiveddate"), F.col("pres_start")
    born = calendar.approximate_birth(F.col("birth_year"), F.col("birth_month"), F.col("birth_day"))
    out = flagged.withColumns(
        {
            "days_nom_to_latest_action": calendar.days_between(received, F.col("latestaction_actiondate")),
            "days_nom_to_conf": calendar.days_to_confirmation(received, F.col("latestaction_actiondate"), F.col("latestaction_text")),
            "received_in_senate_political_era": calendar.senate_era(received),
            "pres_term_idx": calendar.term_index(received, start),
            "days_into_current_term": calendar.days_into_term(received, start),
            "is_latter_term": calendar.later_terms(received, start),
            "days_until_next_presidential_election": calendar.days_to_presidential_election(received),
            "days_until_next_midterm_election": calendar.days_to_midterm(received),
            "congress_num": calendar.congress_number(received),
            "congress_session": calendar.congress_session(received),
            "citation_num": columns.citation_number(F.col("citation")),
            "biography_url": columns.biography_url(F.col("nid")),
            "term_years": text.term_years(F.col("nomination_term_info")),
            "birth_date_approx_dt": born,
            "age_at_nom_days": F.datediff(received, born),
        }
    )
    return filters.plausible_birth(out).drop("pres_start")


def _best(name: str, year: str, order: str, columns: str) -> str:
    """A table of the best row of a history made from orders, for each nomination."""
    return f"""{name} AS (SELECT n.o_orderkey AS k, {columns} FROM kept n JOIN orders h ON h.o_custkey = n.o_custkey AND {year}
        QUALIFY row_number() OVER (PARTITION BY n.o_orderkey ORDER BY {order}) = 1)"""


#: The same flow in SQL: what a description says is known from the parts it was made from.
_SQL = f"""WITH {_PRES}, {_CTRL}, noms AS ({DESCRIBED.format(orders="orders")}),
  kept AS (SELECT * FROM noms WHERE title NOT LIKE '%Attorney%' AND citation NOT LIKE '%-0' AND o_custkey % 6 <> 0),
  {_best("edu", "year(h.o_orderdate) - 1 <= year(n.receiveddate)", "year(h.o_orderdate) DESC, h.o_orderkey DESC", "CASE WHEN h.o_orderkey % 2 = 0 THEN 'J.D.' ELSE 'LL.M.' END AS degree, h.o_orderpriority AS school, year(h.o_orderdate) - 1 AS degree_year, h.o_orderkey AS education_sequence")},
  {_best("car", "year(h.o_orderdate) - 2 <= year(n.receiveddate)", "h.o_orderkey DESC", "'Private practice, ' || CAST(year(h.o_orderdate) - 2 AS VARCHAR) AS latest_career, h.o_orderkey AS career_sequence")},
  {_best("srv", "CAST(h.o_orderdate AS DATE) - 400 <= n.receiveddate", "CAST(h.o_orderdate AS DATE) DESC, h.o_orderkey", "h.o_orderstatus AS fed_service_termination, h.o_orderkey AS fed_service_sequence")},
  people AS (SELECT c_custkey, CAST(1890 + c_custkey % 80 AS INT) AS birth_year, CAST(1 + c_custkey % 12 AS INT) AS birth_month, CAST(1 + c_custkey % 31 AS INT) AS birth_day, c_mktsegment AS segment FROM customer),
  born AS (SELECT *, coalesce(TRY_CAST(printf('%04d-%02d-%02d', birth_year, birth_month, birth_day) AS DATE), make_date(birth_year, 7, 1)) AS b FROM people),
  x AS (SELECT kept.*, kept.receiveddate AS d, born.*, edu.*, car.*, srv.*, pres.number, pres.s, pres.party AS p, pres.name AS pres_name, a.house AS h1, a.senate AS s1, z.house AS h2, z.senate AS s2,
      CASE WHEN action LIKE '%Yea-Nay%' THEN CAST(50 + o_orderkey % 51 AS INT) END AS yea, CASE WHEN action LIKE '%Yea-Nay%' THEN CAST(o_orderkey % 40 AS INT) END AS nay
    FROM kept LEFT JOIN born ON born.c_custkey = kept.o_custkey LEFT JOIN edu ON edu.k = kept.o_orderkey LEFT JOIN car ON car.k = kept.o_orderkey LEFT JOIN srv ON srv.k = kept.o_orderkey
    LEFT JOIN pres ON receiveddate >= pres.s AND receiveddate < pres.e LEFT JOIN ctrl a ON receiveddate >= a.s AND receiveddate < a.e LEFT JOIN ctrl z ON actiondate >= z.s AND actiondate < z.e)
  SELECT citation, o_custkey AS nid, description, receiveddate, action AS latestaction_text, actiondate AS latestaction_actiondate, CAST(NULL AS VARCHAR) AS isprivileged,
    person AS nominee_name, state AS nomination_of_or_from_location, title AS nomination_to_position_title, court AS nomination_to_court_name, CAST(NULL AS VARCHAR) AS nomination_term_info,
    former AS nomination_predecessor_name, reason AS nomination_vacancy_reason, false AS nomination_is_list_nomination, 'high' AS nomination_parsing_confidence, CAST(0 AS INT) AS nomination_multiple_nominees_count,
    CASE WHEN action LIKE 'Confirmed%' THEN 'confirmed' ELSE 'returned' END AS latest_action_taken, yea AS yea_votes, nay AS nay_votes, CASE WHEN yea IS NOT NULL THEN CAST(o_orderkey AS INT) END AS record_vote_number,
    action LIKE '%Voice Vote%' AS was_voice_vote, coalesce(yea >= 100 OR yea > 0 AND nay = 0, false) AS was_unanimous_decision,
    CASE WHEN title LIKE '%Circuit%' THEN 'circuit' ELSE 'district' END AS seat_level, birth_year, birth_month, birth_day, segment, degree, school, CAST(degree_year AS INT) AS degree_year, education_sequence,
    latest_career, career_sequence, fed_service_termination, fed_service_sequence, CAST(CASE WHEN degree IN ('J.D.', 'LL.M.') THEN 5 END AS INT) AS highest_degree_level,
    CAST(number AS INT) AS pres_number, p AS pres_party, pres_name,
    h1 = p AND s1 = p AS unified_at_nom, s1 = p AND h1 <> p AS divided_opp_house_at_nom, h1 = p AND s1 <> p AS divided_opp_senate_at_nom, h1 <> p AND s1 <> p AS fully_divided_at_nom,
    h2 = p AND s2 = p AS unified_at_act, s2 = p AND h2 <> p AS divided_opp_house_at_act, h2 = p AND s2 <> p AS divided_opp_senate_at_act, h2 <> p AND s2 <> p AS fully_divided_at_act,
    CAST(date_diff('day', d, actiondate) AS INT) AS days_nom_to_latest_action, CAST(CASE WHEN action LIKE 'Confirmed%' THEN date_diff('day', d, actiondate) END AS INT) AS days_nom_to_conf,
    CASE WHEN d < DATE '2013-11-21' THEN 'pre-2013' END AS received_in_senate_political_era, {_TERM} AS pres_term_idx,
    CAST(date_diff('day', CAST(s + to_months(48 * ({_TERM} - 1)) AS DATE), d) + 1 AS INT) AS days_into_current_term, {_TERM} - 1 AS is_latter_term,
    CAST({_next(0)} AS INT) AS days_until_next_presidential_election, CAST({_next(2)} AS INT) AS days_until_next_midterm_election,
    CAST(((CASE WHEN year(d) % 2 = 1 THEN year(d) ELSE year(d) - 1 END) - 1789) // 2 + 1 AS INT) AS congress_num, CAST(CASE WHEN year(d) % 2 = 1 THEN 1 ELSE 2 END AS INT) AS congress_session,
    TRY_CAST(replace(citation, 'PN', '') AS INT) AS citation_num, 'http://www.fjc.gov/node/' || CAST(o_custkey AS VARCHAR) AS biography_url, CAST(NULL AS INT) AS term_years,
    b AS birth_date_approx_dt, CAST(date_diff('day', b, d) AS INT) AS age_at_nom_days
  FROM x WHERE b >= DATE '1900-01-01'"""


@query(_SQL)
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of records made from orders and customers."""
    noms = spread(nominations(spark, sf_dir)).select(
        "citation",
        F.col("o_custkey").alias("nid"),
        "description",
        "receiveddate",
        F.col("action").alias("latestaction_text"),
        F.col("actiondate").alias("latestaction_actiondate"),
        F.when(F.col("o_custkey") % 6 == 0, "True").alias("isprivileged"),
    )
    o = table(spark, sf_dir, "orders")
    nid = F.col("o_custkey").alias("nid")
    year = F.year("o_orderdate")
    education = o.select(nid, F.when(F.col("o_orderkey") % 2 == 0, "J.D.").otherwise("LL.M.").alias("degree"), F.col("o_orderpriority").alias("school"), (year - 1).alias("degree_year"), F.col("o_orderkey").alias("sequence"))
    career = o.select(nid, F.concat(F.lit("Private practice, "), (year - 2).cast("string")).alias("professional_career"), F.col("o_orderkey").alias("sequence"))
    service = o.select(nid, F.date_sub(F.to_date("o_orderdate"), 400).alias("nomination_date"), F.col("o_orderstatus").alias("termination"), F.col("o_orderkey").alias("sequence"))
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").alias("nid"), (1890 + F.col("c_custkey") % 80).cast("int").alias("birth_year"), (1 + F.col("c_custkey") % 12).cast("int").alias("birth_month"), (1 + F.col("c_custkey") % 31).cast("int").alias("birth_day"), F.col("c_mktsegment").alias("segment"))
    return build_features(noms, education, career, service, people)
