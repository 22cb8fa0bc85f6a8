"""Queries for profiles, checks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators import columns, filters, quality, summary

from .registry import query, table


@query("SELECT 'customer' AS table, 'nid' AS key, true AS is_unique, 0 AS duplicate_count UNION ALL SELECT 'events', 'citation', false, count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)")
def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables have ids that occur once."""
    catalog = {
        "customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "nid"),
        "events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "citation"),
        "region": table(spark, sf_dir, "region"),
    }
    return quality.validate_catalog(catalog)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


_NULLS = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN value END AS value FROM {events}"


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NULLS, events=table(spark, sf_dir, "events"))


@query(
    f"""WITH x AS ({_NULLS.format(events='events')}), c AS (SELECT count(*) AS n, count(event_id) AS a, count(event_type) AS b, count(value) AS d FROM x)
    SELECT 'event_id' AS column, n - a AS nulls, round(100.0::DOUBLE * (n - a) / n, 2) AS null_percent, (n - a) > 0.5 * n AS mostly_null FROM c UNION ALL SELECT 'event_type', n - b, round(100.0::DOUBLE * (n - b) / n, 2), (n - b) > 0.5 * n FROM c
    UNION ALL SELECT 'value', n - d, round(100.0::DOUBLE * (n - d) / n, 2), (n - d) > 0.5 * n FROM c"""
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_profile(_with_nulls(spark, sf_dir))


@query(f"WITH x AS ({_NULLS.format(events='events')}) SELECT 'event_type' AS column, count(event_type) AS filled, round(count(event_type) / count(*)::DOUBLE, 6) AS rate FROM x UNION ALL SELECT 'value', count(value), round(count(value) / count(*)::DOUBLE, 6) FROM x")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fill_rates(_with_nulls(spark, sf_dir), ["event_type", "value"])


@query(f"WITH x AS ({_NULLS.format(events='events')}) SELECT round(avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_event_type, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_value, count(DISTINCT event_type) AS distinct_event_type FROM x")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_rates(_with_nulls(spark, sf_dir), ["event_type", "value"], "event_type")


@query("SELECT 'o_orderkey' AS column, 'keep' AS verdict UNION ALL SELECT 'o_orderstatus', 'keep' UNION ALL SELECT 'same', CASE WHEN count(*) > 0 THEN 'constant' ELSE 'all null' END FROM orders UNION ALL SELECT 'none', 'all null' UNION ALL SELECT 'some', 'keep'")
def uninformative_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns say nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("same"), F.lit(None).cast("string").alias("none"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("some"))
    return columns.uninformative(o)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def drop_uninformative(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("same"), F.lit(None).cast("string").alias("none"), F.lit("x").alias("nominees_3_name"))
    return columns.drop_matching(columns.drop_uninformative(o))


@query("SELECT 'o_orderdate' AS column, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, count(o_orderdate) AS n FROM orders")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.date_ranges(table(spark, sf_dir, "orders"), ["o_orderdate"])


@query("SELECT 'old' AS column, min(year(o_orderdate)) - 30 AS year FROM orders HAVING min(year(o_orderdate)) - 30 < 1980")
def oldest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.add_months("o_orderdate", -360).alias("old"), F.to_date("o_orderdate").alias("new"))
    return filters.oldest_years(o).withColumn("year", F.col("year").cast("bigint"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m)
    SELECT s.month, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (month)"""
)
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.monthly_series(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.low_cardinality(table(spark, sf_dir, "orders"))


@query("SELECT ['o_custkey', 'o_orderkey'] AS common, ['extra'] AS missing, ['o_orderstatus'] AS extra, 66.67::DOUBLE AS coverage, 46.67::DOUBLE AS score, count(*) AS rows FROM orders")
def schema_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table against those of an older one."""
    o = table(spark, sf_dir, "orders")
    found = quality.schema_comparison(o.select("o_orderkey", "o_custkey", "o_orderstatus"), o.select("o_orderkey", "o_custkey", F.lit(1).alias("extra")), ("extra",))
    return o.agg(F.count(F.lit(1)).alias("rows")).withColumns({k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for k, v in found.items()})


@query("SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM part GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.value_counts(table(spark, sf_dir, "part"), "p_type", share=True)


@query(
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_brand, coalesce(sum(n) OVER (ORDER BY n DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM c)
    SELECT p_partkey, CASE WHEN before < 0.8 * total THEN p_brand ELSE 'other' END AS brand FROM part JOIN r USING (p_brand)"""
)
def bin_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent brands kept, the rest as one."""
    return summary.bin_rare(table(spark, sf_dir, "part"), "p_brand", "brand").select("p_partkey", "brand")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) < 40 THEN 'Other' ELSE p_name END AS p_name FROM part")
def collapse_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.collapse_rare(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 40)


@query(
    """SELECT count(d) AS n, round(min(d), 6) AS min_days, round(max(d), 6) AS max_days, round(avg(d), 6) AS mean_days, round(median(d), 6) AS median_days, round(stddev_samp(d), 6) AS std_days,
    round(min(d / 365.25), 6) AS min_years, round(max(d / 365.25), 6) AS max_years, round(avg(d / 365.25), 6) AS mean_years, round(median(d / 365.25), 6) AS median_years, round(stddev_samp(d / 365.25), 6) AS std_years
    FROM (SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS d FROM orders)"""
)
def age_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.datediff("o_orderdate", F.lit("1990-01-01")).alias("age"))
    return summary.age_summary(o, "age")


@query("SELECT count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(count(v) / count(*)::DOUBLE, 6) AS share FROM (SELECT CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return summary.duration_summary(e, "v")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 AS BIGINT) + CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 0 END WHEN o_orderkey % 2 = 0 THEN 30 END AS total_service_days,
    CASE WHEN o_orderkey % 5 <> 0 THEN 1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END WHEN o_orderkey % 2 = 0 THEN 1 END AS service_count FROM orders"""
)
def prior_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and number of earlier services from pairs of columns."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        d.alias("received"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_sub(d, (F.col("o_orderkey") % 100).cast("int"))).alias("commission_date_1"),
        F.lit(None).cast("date").alias("termination_date_1"),
        F.date_sub(d, 60).alias("commission_date_2"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(d, 30)).otherwise(F.date_sub(d, 90)).alias("termination_date_2"),
    )
    out = summary.prior_service(o, "received", drop=True)
    return out.select("o_orderkey", F.col("total_service_days").cast("bigint").alias("total_service_days"), F.col("service_count").cast("bigint").alias("service_count"))


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 6) AS mae, round(1 - sum((l_extendedprice - l_quantity * 1000) * (l_extendedprice - l_quantity * 1000)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("guess"))  # noqa: E741
    return summary.regression_metrics(l, "l_extendedprice", "guess")
