"""Queries for joins: as of a date, by interval, by name, by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions.dims import CONTROL, PRESIDENTS
from rosterspark.operators import filters, joins, match

from .registry import WITH, nominations, query, table

_PRES = "pres(number, s, e, party, name) AS (VALUES " + ", ".join(f"({n}, DATE '{a}', DATE '{b}', '{p}', '{m}')" for n, a, b, p, m in PRESIDENTS) + ")"
_CTRL = "ctrl(s, e, house, senate) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{h}', '{n}')" for a, b, h, n in CONTROL) + ")"
_DIMS = f"WITH {_PRES}, {_CTRL} "


#: Customers of whom some are unknown and one has very many orders.
_KEY = "CASE WHEN o_custkey % 11 = 1 THEN NULL WHEN o_custkey % 7 = 0 THEN 7 ELSE o_custkey END"
_DATED = f"SELECT o_orderkey, {_KEY} AS o_custkey, CAST(o_orderdate AS DATE) AS order_date FROM {{orders}}"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DATED, orders=table(spark, sf_dir, "orders"))


@query(
    f"""WITH o AS ({_DATED.format(orders='orders')}), d AS (SELECT DISTINCT o_custkey, order_date FROM o WHERE o_custkey IS NOT NULL),
    b AS (SELECT d.o_custkey, d.order_date, max(struct_pack(a := p.order_date, b := p.o_orderkey)) AS m FROM d JOIN o p ON p.o_custkey = d.o_custkey AND p.order_date < d.order_date GROUP BY 1, 2)
    SELECT o.o_orderkey, o.o_custkey, o.order_date, m.b AS prev_orderkey, m.a AS prev_date FROM o LEFT JOIN b ON o.o_custkey = b.o_custkey AND o.order_date = b.order_date"""
)
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's latest order before it."""
    orders = _dated(spark, sf_dir)
    return joins.asof_backward(orders, orders, ["o_custkey"], "order_date", "order_date", "o_orderkey", {"o_orderkey": "prev_orderkey", "order_date": "prev_date"}, strict=True)


@query(
    f"""WITH o AS ({_DATED.format(orders='orders')}), x AS (SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS ship_date, o.o_custkey FROM lineitem l JOIN o ON l.l_orderkey = o.o_orderkey),
    d AS (SELECT DISTINCT o_custkey, ship_date FROM x),
    b AS (SELECT d.o_custkey, d.ship_date, max(struct_pack(a := o.order_date, b := o.o_orderkey)) AS m FROM d JOIN o ON o.o_custkey = d.o_custkey AND o.order_date <= d.ship_date GROUP BY 1, 2)
    SELECT x.l_orderkey, x.l_linenumber, x.ship_date, m.b AS nearest_orderkey, date_diff('day', m.a, x.ship_date) AS gap_days FROM x LEFT JOIN b USING (o_custkey, ship_date)"""
)
def asof_nearest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipment with the customer's order nearest before it."""
    orders = _dated(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_date"))
    ships = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    found = joins.asof_backward(ships, orders, ["o_custkey"], "ship_date", "order_date", "o_orderkey", {"o_orderkey": "nearest_orderkey", "order_date": "__d"})
    return found.select("l_orderkey", "l_linenumber", "ship_date", "nearest_orderkey", F.datediff("ship_date", "__d").cast("bigint").alias("gap_days"))


_HISTORY = f"SELECT {_KEY} AS nid, o_orderstatus AS degree, o_orderpriority AS school, year(o_orderdate) AS degree_year, o_orderkey AS sequence, CAST(o_orderdate AS DATE) AS nomination_date, 'Judge, ' || CAST(year(o_orderdate) AS STRING) || '-' AS professional_career FROM {{orders}}"


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    noms = nominations(spark, sf_dir).select("o_orderkey", F.expr(_KEY).alias("nid"), "receiveddate")
    return noms, spark.sql(_HISTORY, orders=table(spark, sf_dir, "orders"))


def _asof_sql(condition: str, order: str, columns: str) -> str:
    names = ", ".join(columns.split(" AS ")[i].split(",")[0].strip() for i in range(1, len(columns.split(" AS "))))
    return f"""{WITH}, n AS (SELECT o_orderkey, {_KEY} AS nid, receiveddate FROM noms), h AS ({_HISTORY.format(orders='orders')}), best AS (SELECT o_orderkey, {columns} FROM n JOIN h ON n.nid = h.nid AND {condition}
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY {order}) = 1) SELECT n.o_orderkey, n.nid, receiveddate, {names} FROM n LEFT JOIN best USING (o_orderkey)"""


@query(_asof_sql("h.degree_year <= year(receiveddate)", "h.degree_year DESC, h.sequence DESC", "h.degree AS degree, h.school AS school, h.degree_year AS degree_year, h.sequence AS education_sequence"))
def latest_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms, history = _history(spark, sf_dir)
    out = joins.latest_education(noms, history.select("nid", "degree", "school", "degree_year", "sequence"))
    return out.withColumn("degree_year", F.col("degree_year").cast("bigint"))


@query(_asof_sql("h.degree_year <= year(receiveddate)", "h.sequence DESC", "h.professional_career AS latest_career, h.sequence AS career_sequence"))
def latest_career(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms, history = _history(spark, sf_dir)
    return joins.latest_career(noms, history.select("nid", "professional_career", "sequence"))


@query(_asof_sql("h.nomination_date <= receiveddate", "h.nomination_date DESC, h.sequence", "h.degree AS fed_service_degree, h.sequence AS fed_service_sequence"))
def nearest_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms, history = _history(spark, sf_dir)
    return joins.nearest_service(noms, history.select("nid", "nomination_date", "degree", "sequence"), ["degree", "sequence"])


@query(
    f"""{_DIMS} SELECT o_orderkey, number AS pres_number, pres.party AS pres_party, name AS pres_name, house AS house_party, senate AS senate_party FROM orders
    LEFT JOIN pres ON CAST(o_orderdate AS DATE) >= pres.s AND CAST(o_orderdate AS DATE) < pres.e LEFT JOIN ctrl ON CAST(o_orderdate AS DATE) >= ctrl.s AND CAST(o_orderdate AS DATE) < ctrl.e"""
)
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who held which office on the day of each order."""
    found = joins.chambers_at(joins.president_at(table(spark, sf_dir, "orders"), "o_orderdate"), "o_orderdate")
    return found.select("o_orderkey", "pres_number", "pres_party", "pres_name", "house_party", "senate_party")


@query(
    f"""WITH {_PRES}, {_CTRL}, noms AS ({WITH.removeprefix('WITH noms AS (').rstrip().removesuffix(')')}), x AS (SELECT o_orderkey, pres.party AS p, a.house AS h1, a.senate AS s1, b.house AS h2, b.senate AS s2 FROM noms
    LEFT JOIN pres ON receiveddate >= pres.s AND receiveddate < pres.e LEFT JOIN ctrl a ON receiveddate >= a.s AND receiveddate < a.e LEFT JOIN ctrl b ON actiondate >= b.s AND actiondate < b.e)
    SELECT o_orderkey, h1 = p AND s1 = p AS unified_at_nom, s1 = p AND h1 <> p AS divided_opp_house_at_nom, h1 = p AND s1 <> p AS divided_opp_senate_at_nom, h1 <> p AND s1 <> p AS fully_divided_at_nom,
    h2 = p AND s2 = p AS unified_at_act, s2 = p AND h2 <> p AS divided_opp_house_at_act, h2 = p AND s2 <> p AS divided_opp_senate_at_act, h2 <> p AND s2 <> p AS fully_divided_at_act FROM x"""
)
def alignment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms = joins.president_at(nominations(spark, sf_dir), "receiveddate")
    flagged = joins.alignment_flags(noms, "pres_party", "receiveddate", "actiondate")
    return flagged.select("o_orderkey", *[c for c in flagged.columns if c.endswith(("_at_nom", "_at_act"))])


@query(
    f"""WITH {_PRES} SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'known' END, name) AS appointing_president, pres.party AS party_of_appointing_president
    FROM orders LEFT JOIN pres ON CAST(o_orderdate AS DATE) >= pres.s AND CAST(o_orderdate AS DATE) < pres.e"""
)
def fill_president(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("receiveddate"))
    some = orders.withColumn("appointing_president", F.when(F.col("o_orderkey") % 2 == 0, "known"))
    return joins.fill_president(some).drop("receiveddate")


@query(
    """SELECT coalesce(c.k, b.k, a.k) AS o_custkey, coalesce(c.price, b.price, a.price) AS price, coalesce(c.status, b.status) AS status FROM
    (SELECT o_custkey AS k, max(o_totalprice) AS price, 'x' AS status FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c
    FULL JOIN (SELECT o_custkey AS k, min(o_totalprice) AS price, 'y' AS status FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON c.k = b.k
    FULL JOIN (SELECT o_custkey AS k, count(*)::DOUBLE AS price FROM orders GROUP BY 1) a ON coalesce(c.k, b.k) = a.k"""
)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of customers merged, the first value that is there."""
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).withColumn("status", F.lit("x"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("price")).withColumn("status", F.lit("y"))
    c = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("price"))
    return joins.priority_merge([a, b, c], "o_custkey")


@query(
    """SELECT c.c_custkey, c.c_name, n.n_name, n.n_regionkey, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""
)
def demographics_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nid")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "nid")
    out = joins.with_demographics(c, n)
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.join_with_suffixes(out, r, "n_regionkey", "n_regionkey", ("", "_r")).select("c_custkey", "c_name", "n_name", "n_regionkey", "r_name")


@query(
    WITH
    + """SELECT a.citation, a.person AS person_nominee, b.person AS person_nomination, a.state, b.court FROM (SELECT citation, person, state FROM noms) a LEFT JOIN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN citation ELSE 'no ' || citation END AS citation, 'x' || person AS person, court FROM noms) b ON a.citation = b.citation"""
)
def nominee_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominees with nominations by citation; columns of the same name get suffixes."""
    noms = nominations(spark, sf_dir)
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("citation")).otherwise(F.concat(F.lit("no "), "citation"))
    right = noms.select(key.alias("citation"), F.concat(F.lit("x"), "person").alias("person"), "court")
    return joins.nominees_with_nominations(noms.select("citation", "person", "state"), right)


@query(WITH + "SELECT a.citation, a.url, b.person FROM (SELECT citation, 'http://n/' || CAST(o_orderkey AS STRING) AS url FROM noms) a LEFT JOIN (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'http://n/' ELSE 'http://m/' END || CAST(o_orderkey AS STRING) AS url, person FROM noms) b ON a.url = b.url")
def nominee_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations with nominees by the URL inside the nominee's request."""
    noms = nominations(spark, sf_dir)
    url = F.concat(F.lit("http://n/"), F.col("o_orderkey").cast("string"))
    theirs = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "http://n/").otherwise("http://m/"), F.col("o_orderkey").cast("string"))
    request = F.concat(F.lit("{'url': '"), theirs, F.lit("', 'format': 'json'}"))
    return joins.nominees_onto_nominations(noms.select("citation", url.alias("url")), noms.select("person", request.alias("request")), "url")


@query(
    """SELECT s.s_suppkey AS seat_id, s.s_name AS court_x, p.p_name FROM supplier s LEFT JOIN part p ON s.s_suppkey = p.p_partkey"""
)
def master_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seat_id"), F.col("s_name").alias("court_x"))
    noms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seat_id"), "p_name", F.col("p_brand").alias("court"))
    return joins.master_dataset(line, noms)


def _persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    persons = c.select(F.col("c_custkey").alias("nid"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("last"), F.lower("c_mktsegment").alias("first"), F.substring(F.translate((F.col("c_custkey") % 7).cast("string"), "0123456", "abcdefg"), 1, 1).alias("mi"))
    dates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nid"), F.to_date("o_orderdate").alias("nomination_date"))
    s = table(spark, sf_dir, "supplier")
    segment = F.element_at(F.array(*[F.lit(x) for x in ("automobile", "building", "furniture", "household", "machinery")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    records = s.select(F.col("s_suppkey").alias("citation"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("last"), segment.alias("first"), F.substring(F.translate((F.col("s_suppkey") % 7).cast("string"), "0123456", "abcdefg"), 1, 1).alias("mi"), F.expr("date_add(date'1995-01-01', cast(s_suppkey * 37 % 4000 as int))").alias("receiveddate"))
    return records, persons, dates


@query(
    """WITH persons AS (SELECT c_custkey AS nid, 'n' || c_nationkey AS last, lower(c_mktsegment) AS first, translate(CAST(c_custkey % 7 AS STRING), '0123456', 'abcdefg') AS mi FROM customer),
    records AS (SELECT s_suppkey AS citation, 'n' || s_nationkey AS last, ['automobile','building','furniture','household','machinery'][s_suppkey % 5 + 1] AS first, translate(CAST(s_suppkey % 7 AS STRING), '0123456', 'abcdefg') AS mi, DATE '1995-01-01' + CAST(s_suppkey * 37 % 4000 AS INT) AS receiveddate FROM supplier),
    pairs AS (SELECT r.citation, p.nid, r.mi, p.mi AS pmi, r.receiveddate, count(*) OVER (PARTITION BY r.citation) AS k FROM records r JOIN persons p ON r.last = p.last AND r.first = p.first),
    dated AS (SELECT citation, nid FROM (SELECT pairs.citation, pairs.nid, abs(date_diff('day', CAST(o_orderdate AS DATE), receiveddate)) AS gap FROM pairs JOIN orders ON o_custkey = pairs.nid WHERE k > 1) WHERE gap <= 20
      QUALIFY row_number() OVER (PARTITION BY citation ORDER BY gap, nid) = 1),
    initial AS (SELECT citation, min(nid) AS nid FROM pairs WHERE k > 1 AND mi = pmi GROUP BY 1),
    single AS (SELECT citation, nid FROM pairs WHERE k = 1)
    SELECT r.citation, coalesce(s.nid, d.nid, i.nid) AS nid, CASE WHEN s.nid IS NOT NULL THEN 'high_unambiguous' WHEN d.nid IS NOT NULL THEN 'high_date_resolved' WHEN i.nid IS NOT NULL THEN 'medium_mi_resolved' ELSE 'no_match' END AS match_confidence
    FROM records r LEFT JOIN single s USING (citation) LEFT JOIN dated d USING (citation) LEFT JOIN initial i USING (citation)"""
)
def name_date_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers matched to customers by name, then date, then middle initial."""
    records, persons, dates = _persons(spark, sf_dir)
    return match.match_by_name_and_date(records, persons, dates, window=20).select("citation", "nid", "match_confidence")


@query(
    """WITH q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'odd ' || substr(split_part(p_name, ' ', 2), 2, 50) ELSE 'no ' || p_brand END AS name FROM part),
    e AS (SELECT q.name, max(p_partkey) AS v FROM q JOIN part ON p_name = q.name GROUP BY 1),
    l AS (SELECT q.name, min(p_partkey) AS v FROM (SELECT name, split_part(name, ' ', 2) AS t FROM q) q JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS last FROM part) t ON ends_with(t.last, q.t) JOIN part ON split_part(p_name, ' ', 2) = t.last GROUP BY 1)
    SELECT q.name, coalesce(e.v, l.v) AS p_partkey FROM q LEFT JOIN e USING (name) LEFT JOIN l USING (name)"""
)
def suffix_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found by equality, else by the end of the last word."""
    part = table(spark, sf_dir, "part")
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'odd ' || substr(split_part(p_name, ' ', 2), 2, 50) ELSE 'no ' || p_brand END")
    return match.suffix_match(part.select(name.alias("name")), "name", part, "p_name", "p_partkey", "p_partkey")


@query(
    WITH
    + """, j AS (SELECT 'Gale' AS f, o_orderkey AS nid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'of-' END || substr(former, 6, 50) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-X' END AS l, o_orderkey + 1000000 AS seat FROM noms)
    SELECT noms.o_orderkey, noms.former AS predecessor_name, j.nid AS predecessor_nid, CASE WHEN j.nid IS NULL THEN 'unmatched' ELSE 'predecessor_name' END AS seat_match_method, seat AS seat_id
    FROM noms LEFT JOIN j ON noms.former = j.f || ' ' || j.l"""
)
def seat_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations to seats by the predecessor's name."""
    noms = nominations(spark, sf_dir)
    own = F.substring("former", 6, 50)
    last = F.when(F.col("o_orderkey") % 3 == 0, own).otherwise(F.concat(F.lit("of-"), own, F.lit("-X")))
    judges = noms.select(F.lit("Gale").alias("first_name"), last.alias("last_name"), F.col("o_orderkey").alias("nid"))
    line = noms.select(F.col("o_orderkey").alias("nid"), (F.col("o_orderkey") + 1000000).alias("seat_id"))
    return match.crosswalk(noms.select("o_orderkey", "description"), line, judges).select("o_orderkey", "predecessor_name", "predecessor_nid", "seat_match_method", "seat_id")


@query(WITH + "SELECT citation, o_custkey AS nid FROM noms WHERE (o_custkey % 9 = 0 OR 1996 + o_custkey % 5 >= year(receiveddate))")
def drop_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches without those of persons who died before."""
    noms = nominations(spark, sf_dir)
    death = F.when(F.col("c_custkey") % 9 != 0, (1996 + F.col("c_custkey") % 5).cast("int"))
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), death.alias("death_year"))
    return filters.drop_impossible(noms.select("citation", F.col("o_custkey").alias("nid")), noms, persons)
