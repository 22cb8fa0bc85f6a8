"""Queries for text, names, codes, JSON and column-wise operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions import description, jsonx, names, text
from rosterspark.functions.dims import JUDICIAL_TOKENS, NON_JUDICIAL_TITLES
from rosterspark.operators import columns, filters
from rosterspark.sources import tables

from .registry import WITH, nominations, query, table


#: Sentences of every form, made from the parts of a nomination: input, the same for Spark and the oracle.
FORMS = """CASE o_orderkey % 12
    WHEN 0 THEN person || ', of the District of Columbia, to be an Associate Judge of the Superior Court of the District of Columbia for a term of fifteen years, vice ' || former || ', Jr., ' || reason || '.'
    WHEN 1 THEN person || ', of ' || state || ', to be ' || title || ' for the ' || court || ' for a term of eight years.'
    WHEN 2 THEN person || ', of ' || state || ', to the ' || title || ' for the ' || court || ' vice ' || former || ', ' || reason || '.'
    WHEN 3 THEN person || ', of ' || state || ', to be ' || title || ' for the ' || court || '.'
    WHEN 4 THEN person || ', of ' || state || ',to be ' || title || ' for the ' || court || ', vice ' || former || ', ' || reason
    WHEN 5 THEN person || ', of ' || state || ', to be ' || title || ' for the ' || court || ', vice ' || former || '.'
    WHEN 6 THEN person || ', of ' || state || ', to be an Associate Justice of the ' || court || ' for the term of ten years vice ' || former || ' retired.'
    WHEN 7 THEN 'The following-named persons to be members of the Board for a term of six years: ' || person || ', of ' || state || '.'
    WHEN 8 THEN 'Nothing of the kind, ' || person
    WHEN 9 THEN '  '
    WHEN 10 THEN person || ', of ' || state || ', to the ' || title || ' for the ' || court || '.'
    ELSE description END"""


@query(
    WITH
    + """, f AS (SELECT *, o_orderkey % 12 AS k FROM noms)
    SELECT o_orderkey, CASE WHEN k IN (7, 8, 9) THEN NULL ELSE person END AS nominee_name,
    CASE WHEN k IN (7, 8, 9) THEN NULL WHEN k = 0 THEN 'District of Columbia' ELSE state END AS nomination_of_or_from_location,
    CASE WHEN k IN (8, 9) THEN NULL WHEN k = 7 THEN 'members a term of six years: ' || person || ', of ' || state WHEN k = 0 THEN 'Associate Judge' WHEN k = 6 THEN 'Associate Justice' ELSE title END AS nomination_to_position_title,
    CASE WHEN k IN (8, 9) THEN NULL WHEN k = 7 THEN 'Board' WHEN k = 0 THEN 'Superior Court of the District of Columbia' ELSE court END AS nomination_to_court_name,
    CASE k WHEN 0 THEN 'fifteen years' WHEN 1 THEN 'eight years' WHEN 7 THEN 'six years: ' || person END AS nomination_term_info,
    CASE WHEN k IN (1, 3, 7, 8, 9, 10) THEN NULL WHEN k = 0 THEN former || ', Jr.' ELSE former END AS nomination_predecessor_name,
    CASE WHEN k IN (1, 3, 5, 7, 8, 9, 10) THEN NULL WHEN k = 6 THEN 'retired' ELSE reason END AS nomination_vacancy_reason,
    k = 7 AS nomination_is_list_nomination, CASE WHEN k = 7 THEN 'medium' WHEN k IN (8, 9) THEN 'failed' ELSE 'high' END AS nomination_parsing_confidence, CASE WHEN k = 7 THEN 1 ELSE 0 END AS nomination_multiple_nominees_count FROM f"""
)
def parse_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of eleven forms taken apart again into what they were made of."""
    said = tables.spread(nominations(spark, sf_dir)).withColumn("description", F.expr(FORMS))
    return description.parse_descriptions(said.select("o_orderkey", "description")).drop("description")


@query(
    WITH
    + """SELECT o_orderkey, regexp_extract(title, '^(.*)$', 1) AS extracted_position, court AS extracted_court, state AS extracted_state FROM noms"""
)
def court_and_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms = nominations(spark, sf_dir)
    return noms.select("o_orderkey", *[c.alias(n) for n, c in text.court_and_position(F.col("description")).items()])


@query(
    WITH
    + """SELECT o_orderkey, former AS predecessor, CASE reason WHEN 'retired' THEN 'Retirement' WHEN 'retiring' THEN 'Retirement' WHEN 'elevated' THEN 'Elevated' WHEN 'deceased' THEN 'Death' ELSE 'Resignation' END AS vacancy_reason,
    former AS crosswalk_predecessor, CASE WHEN o_orderkey % 4 = 0 THEN former WHEN o_orderkey % 4 = 1 THEN former ELSE 'kept' END AS filled FROM noms"""
)
def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessor and reason from the text, and filled in where missing."""
    noms = nominations(spark, sf_dir)
    d = F.col("description")
    target = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, F.lit(" ")).otherwise(F.lit("kept")).cast("string")
    return noms.select("o_orderkey", text.predecessor(d).alias("predecessor"), text.vacancy_reason(d).alias("vacancy_reason"), text.crosswalk_predecessor(d).alias("crosswalk_predecessor"), text.fill_from(target, text.predecessor(d)).alias("filled"))


@query(
    WITH
    + """SELECT o_orderkey, CASE WHEN action LIKE 'Confirmed%' THEN 'confirmed' WHEN action LIKE 'Returned%' THEN 'returned' END AS latest_action_taken,
    CASE WHEN action LIKE '%Yea-Nay%' THEN 50 + o_orderkey % 51 END AS yea_votes, CASE WHEN action LIKE '%Yea-Nay%' THEN o_orderkey % 40 END AS nay_votes, CASE WHEN action LIKE '%Yea-Nay%' THEN o_orderkey END AS record_vote_number,
    action LIKE '%Voice%' AS was_voice_vote, coalesce(action LIKE '%Yea-Nay%' AND (50 + o_orderkey % 51 >= 100 OR o_orderkey % 40 = 0), false) AS was_unanimous_decision FROM noms"""
)
def latest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    noms = nominations(spark, sf_dir)
    parts = text.latest_action(F.col("action"))
    return noms.select("o_orderkey", *[(c.cast("bigint") if n.endswith(("votes", "number")) else c).alias(n) for n, c in parts.items()])


@query(
    """SELECT o_orderkey, 'Court of ' || o_orderstatus AS court_name_other, CAST(o_orderdate AS DATE) AS other_nom_date, lower(o_orderpriority) AS other_nom_failure_reason FROM orders"""
)
def other_nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed nominations read from sentences."""
    said = F.concat(F.lit("Nominated to Court of "), "o_orderstatus", F.lit(", "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("; "), "o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return o.select("o_orderkey", *[c.alias(n) for n, c in text.other_nomination(F.col("said")).items()])


@query(
    WITH
    + """SELECT o_orderkey, CASE WHEN court = 'Sixth Circuit' AND o_orderkey % 2 = 0 THEN '06' WHEN court = 'Sixth Circuit' THEN '11' END AS circuit,
    CASE WHEN court <> 'Sixth Circuit' THEN 'N' || CASE state WHEN 'Ohio' THEN 'OH' WHEN 'Texas' THEN 'TX' WHEN 'Maine' THEN 'ME' WHEN 'Iowa' THEN 'IA' ELSE 'NY' END END AS court FROM noms"""
)
def court_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit and court codes from descriptions."""
    noms = nominations(spark, sf_dir)
    numbered = F.replace("description", F.lit("Sixth Circuit"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("6th Circuit")).otherwise(F.lit("11th Circuit")))
    found = text.court_from_description(numbered)
    return noms.select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query(
    """SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 13 AND k < 4 THEN n END AS circuit, CASE WHEN k = 4 THEN 'IT' WHEN n BETWEEN 1 AND 13 THEN 'CCA' ELSE code END AS court, k = 4 OR n BETWEEN 1 AND 13 AS is_valid, k <> 4 AS is_identifier
    FROM (SELECT p_partkey, CAST(substr(p_brand, 7) AS INT) AS n, p_partkey % 5 AS k, CASE WHEN p_partkey % 5 = 4 THEN 'IT - ' ELSE substr(p_brand, 7) || ' - CCA' END AS code FROM part)"""
)
def circuit_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes like "09 - CCA" taken apart."""
    code = F.when(F.col("p_partkey") % 5 == 4, F.lit("IT - ")).otherwise(F.concat(F.substring("p_brand", 7, 5), F.lit(" - CCA")))
    p = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return p.select("p_partkey", *[c.alias(n) for n, c in text.circuit_court(F.col("code")).items()], text.valid_court(F.col("code")).alias("is_identifier"))


@query(
    r"""SELECT doc_id, lower(regexp_replace(translate(text, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '^\s+|\s+$', '', 'g')) AS normal, length(regexp_replace(regexp_replace(regexp_replace(lower(text), '[.,]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS clean_length FROM documents"""
)
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in plain letters and lower case."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalise(F.col("text")).alias("normal"), F.length(text.clean_name(F.col("text"))).cast("bigint").alias("clean_length"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ben' ELSE 'Carl' END AS first, CASE c_custkey % 4 WHEN 2 THEN 'Xaver' WHEN 3 THEN 'Yul Z.' END AS middle,
    lower(c_mktsegment) AS last, CASE WHEN c_custkey % 3 = 0 THEN 'Jr.' END AS suffix,
    concat_ws(' ', CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ben' ELSE 'Carl' END, CASE c_custkey % 4 WHEN 2 THEN 'Xaver' WHEN 3 THEN 'Yul Z.' END, lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'Jr.' END) AS full_name,
    CASE c_custkey % 4 WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE '' END AS mi FROM customer"""
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names "last, first middle, suffix" taken apart and put in the other order."""
    first = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ben' ELSE 'Carl' END")
    middle = F.expr("CASE c_custkey % 4 WHEN 2 THEN ' Xaver' WHEN 3 THEN ' Yul Z.' ELSE '' END")
    name = F.concat(F.lower("c_mktsegment"), F.lit(", "), first, middle, F.expr("CASE WHEN c_custkey % 3 = 0 THEN ', Jr.' ELSE '' END"))
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    n = F.col("name")
    return c.select("c_custkey", *[x.alias(k) for k, x in names.name_parts(n).items()], names.first_then_last(n).alias("full_name"), names.split_name(n)["mi"].alias("mi"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS level, CASE o_orderkey % 4 WHEN 0 THEN 'district' WHEN 1 THEN 'circuit' WHEN 2 THEN 'supreme' ELSE 'other' END AS seat,
    CASE o_orderkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'DR' WHEN 3 THEN 'W' ELSE 'Reform' END AS party, year(o_orderdate) AS first_year, CASE o_orderkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 5 END AS term_years FROM orders"""
)
def code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, seats, parties, years and terms from words."""
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("o_orderkey") % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.degree_level(pick(6, "Ph.D.", "LL.M.", "J.D.", "B.A.", "M.A.", "none")).cast("bigint").alias("level"),
        text.seat_level(pick(4, "U.S. District Court", "First Circuit, Court of Appeals", "Supreme Court", "U.S. Tax Court")).alias("seat"),
        text.party_code(pick(5, "Democratic", " republican ", "Democratic-Republican", "whig", "Reform")).alias("party"),
        text.first_year(F.concat(F.lit("Private practice, "), F.year("o_orderdate").cast("string"), F.lit("-2020"))).cast("bigint").alias("first_year"),
        text.term_years(pick(3, "fifteen years", "five years", "life")).cast("bigint").alias("term_years"),
    )


@query(
    "SELECT CASE o_orderkey % 4 WHEN 2 THEN 'Reform' ELSE 'Anti' END AS party, count(*) AS n FROM orders WHERE o_orderkey % 4 IN (2, 3) GROUP BY 1"
)
def unmapped_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    party = F.element_at(F.array(*[F.lit(x) for x in ("Democrat", "R", "Reform", "Anti")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = text.unmapped_parties(table(spark, sf_dir, "orders").select(party.alias("party")), "party")
    return found.withColumnRenamed("count", "n")


@query(
    """SELECT o_orderkey, lower(CAST(o_custkey % 13 AS STRING) || '-' || o_orderstatus || '|' || CASE WHEN o_orderkey % 4 = 0 THEN 'POSITION OPEN' ELSE o_orderpriority END || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS seat_key FROM orders"""
)
def seat_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    incumbent = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", text.seat_key(F.col("o_custkey") % 13, F.col("o_orderstatus"), incumbent, F.col("o_orderdate")).alias("seat_key"))


_TITLES = "|".join(NON_JUDICIAL_TITLES)


@query(WITH + f"SELECT o_orderkey FROM noms WHERE NOT regexp_matches(description, '{_TITLES}') AND NOT ends_with(citation, '-0') AND regexp_matches(lower(description), '{'|'.join(JUDICIAL_TOKENS)}') AND NOT (o_custkey % 6 = 0)")
def judicial_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-judicial, void and privileged nominations left out."""
    noms = nominations(spark, sf_dir).withColumn("isprivileged", F.when(F.col("o_custkey") % 6 == 0, "True").when(F.col("o_custkey") % 6 == 1, "False"))
    kept = filters.only_likely_judicial(filters.drop_dash_zero(filters.drop_non_judicial(noms)))
    return filters.drop_true(kept).select("o_orderkey")


@query(
    WITH
    + """SELECT o_orderkey, title <> 'United States Attorney' AND o_custkey % 3 <> 0 AS odd, o_custkey % 5 <> 4 AS us_date FROM noms"""
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mismatch probe and a strict date form."""
    noms = nominations(spark, sf_dir)
    organisation = F.when(F.col("o_custkey") % 3 == 0, "The Judiciary").when(F.col("o_custkey") % 3 == 1, "Navy")
    date = F.when(F.col("o_custkey") % 5 == 4, F.date_format("receiveddate", "yyyy-MM-dd")).otherwise(F.date_format("receiveddate", "MM/dd/yyyy"))
    return noms.select("o_orderkey", filters.odd_organisation(F.col("title"), organisation).alias("odd"), filters.us_date(date).alias("us_date"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", jsonx.at_path(F.col("props"), "k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, o_orderstatus AS a_s, CAST(year(o_orderdate) AS BIGINT) AS a_y, o_orderpriority AS b_0_p, o_custkey AS b_1_q FROM orders")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as columns."""
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y")).alias("a"), F.array(F.to_json(F.struct(F.col("o_orderpriority").alias("p"))), F.to_json(F.struct(F.col("o_custkey").alias("q")))).alias("b")))
    plain = F.regexp_replace(F.regexp_replace(doc, r'"\{', "{"), r'\}"', "}")
    flat = jsonx.flatten(o.select("o_orderkey", F.replace(plain, F.lit('\\"'), F.lit('"')).alias("j")), "j")
    return flat.select("o_orderkey", "a_s", F.col("a_y").cast("bigint").alias("a_y"), "b_0_p", F.col("b_1_q").cast("bigint").alias("b_1_q"))


@query("SELECT l_orderkey AS citation, 'http://p/' || CAST(l_partkey AS STRING) AS nominee_url, CAST(l_linenumber AS INT) AS ordinal FROM lineitem")
def explode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each element of nested lists."""
    item = F.struct(F.concat(F.lit("http://p/"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_linenumber").alias("ordinal"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("nominees"))
    packed = docs.select(F.to_json(F.struct(F.col("l_orderkey").alias("citation"), "nominees")).alias("nomination"))
    rows = jsonx.expand_records(packed, "nomination", "nominees", {"nominee_url": "url", "ordinal": "ordinal"}, {"citation": "citation"})
    return rows.select(F.col("citation").cast("bigint").alias("citation"), "nominee_url", F.col("ordinal").cast("int").alias("ordinal"))


@query("SELECT CAST(o_orderkey AS STRING) AS citation, 'http://n/' || o_orderstatus AS nominee_url, 100 + CAST(o_orderkey % 20 AS INT) AS congress, CAST(o_custkey AS INT) AS number FROM orders WHERE o_orderkey % 3 <> 0")
def nominee_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("http://n/"), "o_orderstatus"))
    doc = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("citation"), (100 + F.col("o_orderkey") % 20).alias("congress"), F.col("o_custkey").alias("number"), F.array(F.struct(url.alias("url"))).alias("nominees")))
    return jsonx.nominee_urls(table(spark, sf_dir, "orders").select(doc.alias("nomination")))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS STRING) END AS k, CASE WHEN event_id % 4 = 1 THEN 'true' END AS flag,
    CASE WHEN event_id % 4 = 2 THEN 'he said "hi" to ' || event_type END AS said, CASE WHEN event_id % 4 = 2 THEN event_id END AS third,
    CASE WHEN event_id % 4 = 3 THEN 'it''s {' || event_type || '}, None' END AS odd, CASE WHEN event_id % 4 = 3 THEN 'y\\z' || event_type END AS deep FROM events"""
)
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON and Python-like text alike: quotes within quotes, escapes, tuples, nested."""
    e = table(spark, sf_dir, "events")
    texts = [
        F.col("props"),
        F.concat(F.lit("{'flag': True, 'other': None, 't': '"), "event_type", F.lit("'}")),
        F.concat(F.lit("""{'said': 'he said "hi" to """), "event_type", F.lit("', 'n': (1, 2, "), F.col("event_id").cast("string"), F.lit(")}")),
        F.concat(F.lit(r"{u'odd': 'it\'s {"), "event_type", F.lit(r"""}, None', 'deep': {'a': [{'b': ("x", 'y\\z"""), "event_type", F.lit("')}, False, ], }}")),
    ]
    kind = F.col("event_id") % 4
    j = jsonx.lenient(F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).when(kind == 2, texts[2]).otherwise(texts[3]))
    paths = {"k": "$.k", "flag": "$.flag", "said": "$.said", "third": "$.n[2]", "odd": "$.odd", "deep": "$.deep.a[0].b[1]"}
    found = e.select("event_id", j.alias("j")).select("event_id", *[F.get_json_object("j", path).alias(n) for n, path in paths.items()])
    return found.withColumn("third", F.col("third").cast("bigint"))


@query("SELECT o_orderkey, 1 AS slot, CAST(o_orderdate AS DATE) AS nomination_date FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_orderdate AS DATE) + 10 FROM orders WHERE o_orderkey % 2 = 0")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("nomination_date_(1)"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(d, 10)).alias("nomination_date_(2)"))
    return jsonx.wide_to_long(o, ["o_orderkey"], "nomination_date_", "nomination_date")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INT) END AS order_year, trim(o_orderpriority) AS note FROM orders"""
)
def coerce_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns typed by their names: two forms of dates, years, all trimmed."""
    k = F.col("o_orderkey") % 4
    date = F.when(k == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("32/03/1889")
    year = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.year("o_orderdate").cast("string"), F.lit(".0"))).otherwise("unknown")
    o = table(spark, sf_dir, "orders").select("o_orderkey", date.alias("Order Date"), year.alias("Order Year"), F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n ")).alias("Note"))
    return columns.coerce_by_name(columns.normalise_columns(columns.trim_strings(o)))


@query(
    """SELECT o_orderkey, 'http://www.fjc.gov/node/' || CAST(o_custkey AS STRING) AS url, CASE WHEN o_orderkey % 10 NOT IN (3, 7) THEN CAST(o_orderkey AS INT) END AS number, CASE WHEN o_orderstatus = 'F' THEN 'CA' END AS letters,
    o_orderstatus <> 'P' AS given, o_orderstatus = 'O' AS flag FROM orders"""
)
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs, numbers, letters and flags from other columns."""
    noms = nominations(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    s = F.col("o_orderstatus")
    return noms.select(
        "o_orderkey",
        columns.biography_url(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("url"),
        columns.citation_number(F.col("citation")).alias("number"),
        columns.seat_letters(F.lit("CA0912"), F.when(s == "F", "confirmed").otherwise("returned")).alias("letters"),
        columns.is_given(F.when(s == "F", "text").when(s == "O", "0")).alias("given"),
        columns.or_false(F.when(s == "O", "true").when(s == "F", "false")).alias("flag"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 100 <> 7")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values corrected and rows deleted from tables of corrections."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    fixes = c.filter("c_custkey % 50 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"))
    return columns.correct(c, ["c_custkey"], fixes, c.filter("c_custkey % 100 = 7").select("c_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def fill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return columns.fill_categories(o, ["o_orderstatus"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def pipe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with pipes to the shared folder and read again."""
    path = tables.scratch(spark, "pipes")
    tables.write_pipes(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    back = tables.read_pipes(spark, path)
    return back.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def csv_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose date columns are found by name."""
    path = tables.scratch(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-M-d")).alias("Order Date"))
    o.write.option("header", True).csv(path)
    return tables.read_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, CAST(count(*) AS STRING) || ' records retrieved from ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS message FROM events")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.snapshot_summary(table(spark, sf_dir, "events"), "ts")




@query("SELECT p_partkey, lower(translate('ÁÉ ' || p_name || 'ñ', 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')) AS court_name, p_brand AS other FROM part")
def keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with keyword names in plain lower case, others as they are."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" ÁÉ "), "p_name", F.lit("ñ ")).alias("court_name"), F.col("p_brand").alias("other"))
    return text.normalise_keyword_columns(p)


@query(
    WITH
    + """SELECT citation, description, receiveddate AS receiveddate, action AS latestaction_text, person AS nominee_first_name, former AS nominee_last_name, 1::BIGINT AS nominee_ordinal, true AS is_full_detail,
    CASE WHEN court <> 'Sixth Circuit' THEN 'N' || CASE state WHEN 'Ohio' THEN 'OH' WHEN 'Texas' THEN 'TX' WHEN 'Maine' THEN 'ME' WHEN 'Iowa' THEN 'IA' ELSE 'NY' END END AS parsed_court FROM noms"""
)
def nominee_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nominee of saved payloads, with the court its description names."""
    noms = nominations(spark, sf_dir)
    item = F.struct(F.col("person").alias("firstName"), F.col("former").alias("lastName"), F.lit(1).alias("ordinal"))
    doc = F.to_json(F.struct("citation", "description", F.col("receiveddate").alias("receivedDate"), F.struct(F.col("action").alias("text")).alias("latestAction"), F.array(item).alias("nominees")))
    rows = jsonx.nominee_records(noms.select(doc.alias("nomination")))
    typed = rows.withColumns({"receiveddate": F.to_date("receiveddate"), "nominee_ordinal": F.col("nominee_ordinal").cast("bigint")})
    return typed.drop("nominee_url", "parsed_circuit")


@query("SELECT 'PN' || CAST(o_orderkey AS STRING) AS citation, 'http://n/' || CAST(o_custkey AS STRING) AS url, o_orderdate AS retrieval_date FROM orders")
def payload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved API payloads written to the shared folder and scanned again."""
    path = tables.scratch(spark, "payloads")
    o = table(spark, sf_dir, "orders")
    nested = F.struct(F.concat(F.lit("PN"), F.col("o_orderkey").cast("string")).alias("citation")), F.struct(F.concat(F.lit("http://n/"), F.col("o_custkey").cast("string")).alias("url"))
    o.select(nested[0].alias("nomination"), nested[1].alias("request"), F.col("o_orderdate").alias("retrieval_date")).write.json(path)
    back = tables.read_payloads(spark, path)
    return back.select(jsonx.at_path(F.col("nomination"), "citation").alias("citation"), jsonx.at_path(F.col("request"), "url").alias("url"), "retrieval_date")


@query("SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS seat, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS vacancy_date FROM orders")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped records with numbers and dates where they are such."""
    seat = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).otherwise("none")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return tables.typed_records(table(spark, sf_dir, "orders").select(seat.alias("seat"), date.alias("vacancy_date")))
