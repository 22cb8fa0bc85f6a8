"""Queries for whole catalogs of tables, saved histories, fields and saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions import description
from rosterspark.operators import columns, filters, modeling, quality, similar
from rosterspark.sources import tables

from .registry import WITH, nominations, query, table


@query("SELECT 'nation' AS source, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with rows written as a catalog and those that are there read again."""
    folder = tables.scratch(spark, "catalog")
    nation, region = (table(spark, sf_dir, n) for n in ("nation", "region"))
    tables.write_catalog({"nation": nation, "region": region, "none": region.filter("false")}, folder, "csv")
    found = tables.read_catalog(spark, folder, ["nation", "region", "none", "absent"])
    parts = [found[n].select(F.lit(n).alias("source"), F.col(f"{n[0]}_{n}key").alias("key"), F.col(f"{n[0]}_name").alias("name")) for n in sorted(found)]
    return parts[0].unionByName(parts[1])


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def history_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table written and loaded for scoring; where there is none, nothing is loaded."""
    folder = tables.scratch(spark, "history")
    if tables.read_history(spark, f"{folder}/features") is not None:
        raise RuntimeError("a history that nobody wrote")
    tables.write_catalog({"features": table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")}, folder)
    return tables.read_history(spark, f"{folder}/features")


@query("SELECT 'customers' AS source, c_custkey AS own_key, c_name AS full_name FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier")
def normalised_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of several tables under normal names."""
    raw = {
        "customers": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Own Key"), F.col("c_name").alias("FULL Name")),
        "suppliers": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("OWN KEY"), F.col("s_name").alias("Full Name")),
    }
    parts = [df.select(F.lit(n).alias("source"), "own_key", "full_name") for n, df in columns.normalise_all(raw).items()]
    return parts[0].unionByName(parts[1])


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS due, strftime(o_orderdate, '%m/%d/%Y') AS other FROM orders"""
)
def named_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in two forms where they are asked for; texts that are none become null."""
    day = F.to_date("o_orderdate")
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", us(day).alias("filed"), F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_add(day, 30).cast("string")).alias("due"), us(day).alias("other")
    )
    return columns.coerce_dates(o, ["filed", "due", "absent"])


@query("SELECT n_nationkey, n_name FROM nation")
def without_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.drop_columns(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey", "absent"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS target FROM orders WHERE o_orderstatus = 'F'")
def rows_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("target"))
    return filters.with_target(o, "target")


@query(WITH + "SELECT o_orderkey, court AS nomination_to_court_name, former AS nomination_predecessor_name FROM noms")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single fields of descriptions."""
    noms = nominations(spark, sf_dir).select("o_orderkey", "description")
    court = description.parsed_field(noms, "nomination_to_court_name")
    return description.parsed_field(court, "nomination_predecessor_name").drop("description")


@query(
    """WITH x AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 0) AS f FROM orders)
    SELECT 'o_orderkey' AS column, 'common' AS status, false AS critical, 0.0::DOUBLE AS null_percent, false AS mostly_null FROM x
    UNION ALL SELECT 'clerk', 'common', true, round(100 * (n - (n - f)) / n::DOUBLE, 2), 100 * (n - (n - f)) / n::DOUBLE > 50 FROM x
    UNION ALL SELECT 'added', 'extra', false, 0.0, false FROM x UNION ALL SELECT 'lost', 'missing', true, NULL, false FROM x"""
)
def field_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of a table and of an older one: there or not, how often null, and whether that is critical."""
    o = table(spark, sf_dir, "orders")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "x").alias("clerk"), F.lit(1).alias("added"))
    old = o.select("o_orderkey", F.lit("x").alias("clerk"), F.lit(1).alias("lost"))
    return quality.field_comparison(new, old, ("clerk", "lost"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases: one price in seven is unknown."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"), F.col("p_retailprice").alias("target"))


#: Every hundredth part against all parts; unknown prices count as the mean of all.
_CASES = """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice::DOUBLE END AS price, p_retailprice::DOUBLE AS target FROM part),
  v AS (SELECT *, size * sqrt(2.0::DOUBLE) AS x, coalesce(price, (SELECT avg(price) FROM p)) * 1.0 AS y, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS source FROM p),
  d AS (SELECT q.id AS query_id, q.size AS qs, q.price AS qp, r.*, r.source || ':' || CAST(r.id AS VARCHAR) AS ref_id, sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) AS dist FROM v q, v r WHERE q.id % 100 = 0),
  s AS (SELECT *, CASE WHEN max(dist) OVER w > 0 THEN 1 - dist / max(dist) OVER w ELSE 1.0 END AS similarity FROM d WINDOW w AS (PARTITION BY query_id)),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) <= 3),
  c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM b WHERE id <> query_id QUALIFY rank <= 2),
  e AS (SELECT *, 2 * (1 - abs(qs - size) / (abs(qs) + abs(size) + 1e-8)) AS ks, coalesce(1 - abs(qp - price) / (abs(qp) + abs(price) + 1e-8), 0.5) AS kp FROM c)"""


@query(
    _CASES
    + """ SELECT query_id, id, source AS _dataset_source, target, round(similarity, 6) AS similarity, rank,
    CASE WHEN ks > kp THEN printf('size (%.3f), price (%.3f)', ks, kp) ELSE printf('price (%.3f), size (%.3f)', kp, ks) END AS _explanation FROM e"""
)
def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth part the two most alike, what makes them alike, and unknown prices by the mean of all."""
    p = _parts(spark, sf_dir)
    found = similar.most_similar_cases(p.filter("id % 100 = 0"), p.filter("id % 5 <> 0"), p.filter("id % 5 = 0"), ["size", "price"], [2.0, 1.0], "target", k=2, metric="euclidean")
    return found.withColumns({"similarity": F.round("similarity", 6), "rank": F.col("rank").cast("bigint")})


@query(_CASES + " SELECT query_id, id, source AS _dataset_source, target, round(similarity, 6) AS similarity, round(900 + 3 * qs, 6) AS predicted_days, round(900 + 3 * qs - target, 6) AS difference FROM e WHERE rank = 1")
def scenario_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar part of every hundredth one beside what a given line says of it."""
    p = _parts(spark, sf_dir)
    cases = similar.most_similar_cases(p.filter("id % 100 = 0"), p.filter("id % 5 <> 0"), p.filter("id % 5 = 0"), ["size", "price"], [2.0, 1.0], "target", k=2, metric="euclidean")
    said = similar.scenario_report(cases, p.withColumn("prediction", 900 + 3 * F.col("size")))
    return said.select("query_id", "id", "_dataset_source", "target", *[F.round(c, 6).alias(c) for c in ("similarity", "predicted_days", "difference")])


@query("SELECT count(*) AS rows, true AS same_predictions, 'size' AS first_column, 'price of parts' AS about FROM part")
def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a boosted model before it is saved and after it is loaded, with what is kept beside it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), "p_type", F.col("p_retailprice").alias("target"))
    model = modeling.fit_trees(p, ["size"], ["p_type"], "target", "id")
    folder = tables.scratch(spark, "model")
    modeling.save_model(model, folder, ["size", "p_type"], {"about": "price of parts"})
    again, about = modeling.load_model(folder)
    before = modeling.batch_score(p, model, about["feature_columns"]).select("id", F.col("prediction").alias("before"))
    after = modeling.batch_score(p, again, about["feature_columns"]).select("id", F.col("prediction").alias("after"))
    return before.join(after, "id").agg(
        F.count(F.lit(1)).alias("rows"), F.every(F.col("before") == F.col("after")).alias("same_predictions"), F.lit(about["feature_columns"][0]).alias("first_column"), F.lit(about["metadata"]["about"]).alias("about")
    )


@query()
def searched_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted model of a two-stage random search (few draws and trees): its parameters, and errors of parts."""
    from rosterspark.operators.summary import regression_metrics

    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), "p_type", F.col("p_retailprice").alias("target"))
    model = modeling.two_stage_search(p, ["size"], ["p_type"], "target", {"maxDepth": [3, 4], "stepSize": [0.1, 0.3], "subsamplingRate": [0.8, 1.0]}, draws=(2, 1), folds=(2, 2), maxIter=5)
    last = model.stages[-1]
    found = {n: last.getOrDefault(last.getParam(n)) for n in ("maxDepth", "stepSize", "maxIter")}
    return regression_metrics(model.transform(p), "target", "prediction").withColumns({n: F.lit(v) for n, v in found.items()})
