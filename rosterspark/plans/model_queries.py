"""Queries for similarity and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators import modeling, similar, summary

from .registry import query, table

_W = [1.0 + i % 4 for i in range(64)]
_SQLW = "[" + ", ".join(f"sqrt({w})" for w in _W) + "]"
_PAIRS = f"""WITH e AS (SELECT vec_id, list_transform(generate_series(1, 64), lambda i: embedding[i]::DOUBLE * {_SQLW}[i]) AS v FROM embeddings),
 p AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, q.v AS a, r.v AS b FROM e q, e r WHERE q.vec_id % 100 = 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "ref_id")


def _top(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    queries, reference = _vectors(spark, sf_dir)
    best = similar.top_similar(queries, reference, _W, 3, metric)
    return best.select("query_id", "ref_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _sql(score: str) -> str:
    return f"{_PAIRS}, s AS ({score}) SELECT query_id, ref_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM s QUALIFY rank <= 3"


@query(_sql("SELECT query_id, ref_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS similarity FROM p"))
def similar_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every hundredth vector, by cosine."""
    return _top(spark, sf_dir, "cosine")


@query(_sql("SELECT query_id, ref_id, 1 - d / max(d) OVER (PARTITION BY query_id) AS similarity FROM (SELECT query_id, ref_id, list_distance(a, b) AS d FROM p)"))
def similar_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "euclidean")


@query(_sql("SELECT query_id, ref_id, 1 - d / max(d) OVER (PARTITION BY query_id) AS similarity FROM (SELECT query_id, ref_id, list_sum(list_transform(generate_series(1, 64), lambda i: abs(a[i] - b[i]))) AS d FROM p)"))
def similar_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "manhattan")


@query()
def most_similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth part the most alike, with what makes them alike."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"), F.col("p_retailprice").alias("target"))
    split = modeling.stratified_split(p.withColumn("s", F.lit("x")), "s", "id").drop("s")
    cases = similar.most_similar_cases(p.filter("id % 100 = 0"), split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split"), ["size", "price"], [2.0, 1.0], "target", k=2, metric="euclidean")
    return cases.withColumn("similarity", F.round("similarity", 6))


@query("SELECT o_orderpriority AS stratum, CAST(ceil(0.2 * count(*)) AS BIGINT) AS test, count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS train FROM orders GROUP BY 1")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each stratum are in either part."""
    split = modeling.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    n = lambda part: F.sum((F.col("split") == part).cast("bigint")).alias(part)
    return split.groupBy(F.col("o_orderpriority").alias("stratum")).agg(n("test"), n("train"))


@query(
    """SELECT p_type AS model, round(avg(p_size), 6) AS mae, round(avg(p_size) / 60, 6) AS r2, CASE WHEN round(avg(p_size), 6) < 30 THEN 'excellent' ELSE 'good' END AS mae_quality,
    CASE WHEN round(avg(p_size) / 60, 6) > 0.7 THEN 'excellent' WHEN round(avg(p_size) / 60, 6) > 0.5 THEN 'good' WHEN round(avg(p_size) / 60, 6) > 0.3 THEN 'fair' ELSE 'poor' END AS r2_quality,
    CASE WHEN round(avg(p_size) / 60, 6) > 0.7 AND round(avg(p_size), 6) < 30 THEN 'excellent' WHEN round(avg(p_size) / 60, 6) > 0.5 THEN 'good' WHEN round(avg(p_size) / 60, 6) > 0.3 THEN 'fair' ELSE 'poor' END AS verdict FROM part GROUP BY 1"""
)
def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for tables of metrics."""
    metrics = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("model")).agg(F.round(F.avg("p_size"), 6).alias("mae"), F.round(F.avg("p_size") / 60, 6).alias("r2"))
    return modeling.quality_labels(metrics)


@query(
    """WITH m AS (SELECT p_type AS model, round(avg(p_size), 6) AS test_mae FROM part GROUP BY 1), x AS (SELECT *, first(test_mae) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, min(test_mae) OVER () AS b FROM m)
    SELECT model, test_mae, round(100 * (f - test_mae) / f, 6) AS improvement, test_mae = b AS best FROM x"""
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("model")).agg(F.round(F.avg("p_size"), 6).alias("test_mae"))
    return modeling.compare_models(metrics, order="model")


_HOT = "[CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END]"


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, CASE WHEN l_orderkey % 6 <> 0 THEN l_discount::DOUBLE END AS d, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag WHEN l_orderkey % 10 = 0 THEN 'new' END AS l_returnflag FROM lineitem),
    t AS (SELECT * FROM x WHERE l_orderkey % 5 <> 0), m AS (SELECT avg(q) AS mq, avg(d) AS md FROM t), s AS (SELECT stddev_samp(q) AS sq, stddev_samp(coalesce(d, md)) AS sd FROM t, m)
    SELECT l_orderkey, l_linenumber, list_transform(list_concat([(q - mq) / sq, (coalesce(d, md) - md) / sd], {_HOT}), lambda v: round(v, 6)) AS features FROM x, m, s"""
)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of prices sees of each line: scaled numbers, missing ones by the mean, flags of categories without the
    first; categories that the training rows lack are all zeros."""
    known = F.col("l_orderkey") % 5 != 0
    l = table(spark, sf_dir, "lineitem").select(  # noqa: E741
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("double").alias("quantity"),
        F.when(F.col("l_orderkey") % 6 != 0, F.col("l_discount").cast("double")).alias("discount"),
        F.when(known, F.col("l_returnflag")).when(F.col("l_orderkey") % 10 == 0, "new").alias("flag"),
    )
    rows = modeling.feature_matrix(l, l.filter(known), ["quantity", "discount"], ["flag"])
    return rows.select("l_orderkey", "l_linenumber", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query()
def gbt_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted model of prices, its error on train and test, and labels."""
    l = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_returnflag", F.col("l_extendedprice").alias("target"))  # noqa: E741
    split = modeling.stratified_split(l, "l_returnflag", "id")
    fitted = modeling.fit_trees(split.filter("split = 'train'"), ["l_quantity", "l_discount"], ["l_returnflag"], "target", "id")
    scored = modeling.batch_score(split, fitted, ["l_quantity", "l_discount", "l_returnflag"])
    parts = [summary.regression_metrics(scored.filter(F.col("split") == p), "target", "prediction").withColumn("part", F.lit(p)) for p in ("train", "test")]
    return modeling.quality_labels(parts[0].unionByName(parts[1]))


@query()
def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a boosted model of prices looks at."""
    l = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_returnflag", F.col("l_extendedprice").alias("target"))  # noqa: E741
    model = modeling.fit_trees(l, ["l_quantity", "l_discount"], ["l_returnflag"], "target", "id")
    return modeling.feature_importances(model, model.transform(l))


@query()
def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar part of every hundredth one beside what a boosted model says of it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), "p_type", F.col("p_retailprice").alias("target"))
    model = modeling.fit_trees(p, ["size"], ["p_type"], "target", "id")
    asked = p.filter("id % 100 = 0")
    cases = similar.most_similar_cases(asked, p.filter("id % 5 != 0"), p.filter("id % 5 = 0"), ["size"], [1.0], "target")
    return similar.scenario_report(cases, model.transform(asked))
