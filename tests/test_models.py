from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rosterspark.operators import modeling


def test_the_first_category_and_unknown_ones_are_zeros(spark, tmp_path):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    other = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "k string")
    model = modeling.FirstDropped(["k"], ["v"]).fit(train)
    assert model.categories() == {"k": ["a", "b", "c"]}
    rows = lambda m: {r["k"]: list(r["x"]) for r in m.transform(other).select("k", vector_to_array("v").alias("x")).collect()}
    assert rows(model) == {"a": [0, 0], "b": [1, 0], "c": [0, 1], "new": [0, 0], None: [0, 0]}
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    assert rows(PipelineModel.load(str(tmp_path / "m"))) == rows(model)
    one = modeling.FirstDropped(["k"], ["v"]).fit(train.filter("k = 'a'"))
    assert set(map(tuple, rows(one).values())) == {()}


@pytest.mark.parametrize(
    "name, best, values",
    [
        ("stepSize", 0.1, [0.08, 0.09, 0.1, 0.11, 0.12]),
        ("stepSize", 0.495, [0.475, 0.485, 0.495, 0.5]),
        ("subsamplingRate", 1.0, [0.95, 0.975, 1.0]),
        ("maxIter", 500, [100, 500, 1000, 1500]),
        ("maxDepth", 3, [3, 4, 5]),
        ("maxDepth", 8, [6, 7, 8, 9, 10]),
        ("minInstancesPerNode", 2, [1, 2, 3, 4]),
        ("regParam", 0.5, [0.25, 0.4, 0.5, 0.6, 1.0]),
        ("regParam", 0, [0.0, 0.01, 0.05, 0.1, 0.2]),
        ("maxBins", 32, [32]),
    ],
)
def test_refined_values(name, best, values):
    assert modeling.refined(name, best) == pytest.approx(values)


def test_refined_to_one_point_and_drawn_from_lists(spark):
    from pyspark.ml.regression import GBTRegressor

    assert modeling.refined("stepSize", 0.1, 1) == [0.1] and modeling.refined("maxDepth", 5, 1) == [5]
    maps = modeling.draw_parameters(GBTRegressor(), {"maxDepth": [3, 9], "maxBins": (4, 6), "stepSize": (0.1, 0.2)}, 50)
    drawn = [{p.name: v for p, v in m.items()} for m in maps]
    assert {m["maxDepth"] for m in drawn} == {3, 9} and {m["maxBins"] for m in drawn} == {4, 5, 6} and all(0.1 <= m["stepSize"] <= 0.2 for m in drawn)


def test_boosting_stops_when_held_out_rows_gain_nothing(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"), F.lit("k").alias("c"), (F.col("id") % 10 * 3).cast("double").alias("y"))
    model = modeling.fit_trees(df, ["x"], ["c"], "y", "id", maxDepth=2, stepSize=0.5)
    trees = model.stages[-1].getNumTrees
    assert 1 < trees < 100
    scored = model.transform(df)
    assert scored.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1.5
    assert modeling.feature_importances(model, scored).first()["feature"] == "x"
    again = modeling.fit_trees(df.repartition(3), ["x"], ["c"], "y", "id", maxDepth=2, stepSize=0.5)
    assert again.stages[-1].getNumTrees == trees
