"""Training, scoring and comparing models with Spark ML."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterspark.sources.tables import checkpoints, settle

from .columns import fill_categories


def stratified_split(df: DataFrame, stratum: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exactly the rounded-up share of each stratum is ``test``, chosen by a hash of the key.

    Rows are ranked in 256 ranges of the hash within a stratum, and the ranges' sizes say where the cut falls: no task
    orders a whole stratum."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__b", F.shiftrightunsigned("__h", 56).cast("int"))
    sizes = hashed.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(stratum).orderBy("__b")
    offsets = sizes.select(
        F.col(stratum).alias("__s"),
        F.col("__b").alias("__c"),
        F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(stratum)).alias("__all"),
    )
    unsigned = F.shiftrightunsigned("__h", 1)
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__b").orderBy(unsigned, "__h", key)))
    joined = ranked.join(offsets, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")))
    chosen = F.col("__before") + F.col("__r") <= F.ceil(F.lit(test) * F.col("__all"))
    return joined.withColumn("split", F.when(chosen, "test").otherwise("train")).select(*df.columns, "split")


class _Vocabularies(Params):
    """What the encoder and its fitted form share."""

    inputCols = Param(Params._dummy(), "inputCols", "categories", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "vectors", TypeConverters.toListString)
    vocabularies = Param(Params._dummy(), "vocabularies", "categories of each column, in order", TypeConverters.toString)

    def _pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.outputCols)))


class FirstDropped(Estimator, _Vocabularies, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot categories in the order of their names, without the first: it, unknown and missing ones are all zeros."""

    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCols=outputCols or [])

    def _fit(self, dataset: DataFrame) -> FirstDroppedModel:
        names = self.getOrDefault(self.inputCols)
        # a column of the matrix for each: as many as the model can have
        row = dataset.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(names)]).first()
        model = FirstDroppedModel()
        model._set(inputCols=names, outputCols=self.getOrDefault(self.outputCols), vocabularies=json.dumps([list(x) for x in row]))
        return self._copyValues(model)


class FirstDroppedModel(Model, _Vocabularies, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted :class:`FirstDropped`."""

    def categories(self) -> dict[str, list[str]]:
        return dict(zip(self.getOrDefault(self.inputCols), json.loads(self.getOrDefault(self.vocabularies))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for (c, into), words in zip(self._pairs(), self.categories().values()):
            place = F.array_position(F.from_json(F.lit(json.dumps(words)), "array<string>"), F.col(c).cast("string")) - 1
            zeros = F.array_repeat(F.lit(0.0), max(0, len(words) - 1))
            hot = F.when(place > 0, F.transform(zeros, lambda x, i: F.when(i + 1 == place, 1.0).otherwise(x))).otherwise(zeros)
            flags = [{"idx": i, "name": w} for i, w in enumerate(words[1:])]
            known = {"num_attrs": len(flags)} | ({"attrs": {"binary": flags}} if flags else {})
            out = out.withColumn(into, array_to_vector(hot).alias(into, metadata={"ml_attr": known}))
        return out


def feature_stages(numeric: list[str], categorical: list[str]) -> list:
    """Mean for missing numbers, scaling; one-hot categories without the first, unknown ones all zeros.  Missing numbers
    also get a flag column of their own by :func:`with_missing_flags`."""
    filled, hot = [f"{c}__filled" for c in numeric], [f"{c}__hot" for c in categorical]
    stages = [Imputer(inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__num")]
    stages += [StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True), FirstDropped(categorical, hot)]
    return [*stages, VectorAssembler(inputCols=["__scaled", *hot], outputCol="features")]


def feature_matrix(df: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``df`` with ``features``: the row of the matrix that models see, as an array; fitted on ``train``."""
    stages = Pipeline(stages=feature_stages(numeric, categorical)).fit(train)
    scratch = [c for c in stages.transform(df.limit(0)).columns if c not in df.columns]
    return stages.transform(df).withColumn("features", vector_to_array("features")).drop(*[c for c in scratch if c != "features"])


def with_missing_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in numeric})


#: Of how many rows one is held out to tell when further trees don't help, and the share of its error that they must save.
HELD_OUT, TOLERANCE = 5, 0.01
#: How a parameter is narrowed around its best value, with its bounds.
REFINED: dict[str, tuple[str, float, float, float]] = {
    "stepSize": ("continuous", 0.02, 0.001, 0.5),
    "subsamplingRate": ("continuous", 0.05, 0.5, 1.0),
    "minInfoGain": ("continuous", 0.1, 0.0, 2.0),
    "maxIter": ("whole", 1000, 100, 10000),
    "maxDepth": ("whole", 1, 3, 15),
    "minInstancesPerNode": ("whole", 2, 1, 20),
    "regParam": ("factors", 0.0, 0.0, float("inf")),
}
#: Factors of a parameter that acts by its order of size, and what is tried where its best value is 0.
FACTORS, FROM_ZERO = (0.5, 0.8, 1.0, 1.2, 2.0), (0.0, 0.01, 0.05, 0.1, 0.2)


def boosted_trees(numeric: list[str], categorical: list[str], label: str, **parameters) -> Pipeline:
    """Up to 500 trees of depth 6.  Where the rows have a boolean column HELD (see :func:`with_held_out`), boosting stops
    once the error of the held-out rows no longer falls by TOLERANCE.  Lineage is cut every ten trees."""
    settings = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.1, "seed": 42, "labelCol": label, "featuresCol": "features", "checkpointInterval": 10, "validationTol": TOLERANCE} | parameters
    return Pipeline(stages=[*feature_stages(numeric, categorical), GBTRegressor(**settings)])


HELD = "__held_out"


def with_held_out(df: DataFrame, key: str, one_in: int = HELD_OUT) -> DataFrame:
    """``df`` with HELD: one in ``one_in`` rows, by a hash of ``key``."""
    return df.withColumn(HELD, F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(one_in)) == 0)


def fit_trees(df: DataFrame, numeric: list[str], categorical: list[str], label: str, key: str, **parameters) -> PipelineModel:
    """:func:`boosted_trees` fitted with early stopping on rows held out by ``key``."""
    checkpoints(df.sparkSession)
    columns = dict.fromkeys([*numeric, *categorical, label, key])
    rows = settle(with_held_out(df.select(*columns), key))  # each tree reads them again
    return boosted_trees(numeric, categorical, label, validationIndicatorCol=HELD, **parameters).fit(rows)


def draw_parameters(regressor: GBTRegressor, ranges: dict[str, tuple | list], n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter maps.  A list is what to choose from; a pair is (least, most), whole numbers for whole
    bounds."""
    rnd = random.Random(seed)

    def pick(r: tuple | list) -> float:
        if isinstance(r, list):
            return rnd.choice(r)
        return rnd.randint(*r) if all(isinstance(x, int) for x in r) else rnd.uniform(*r)

    return [{regressor.getParam(k): pick(r) for k, r in ranges.items()} for _ in range(n)]


def refined(name: str, best: float, points: int = 5) -> list[float]:
    """Values of a parameter to try around its best one, ascending and without repeats: steps of a fixed width, which add up
    to the parameter's reach on either side, within its bounds; whole steps for whole numbers; factors for one that acts by
    its order of size.  A parameter that is not in REFINED keeps its value."""
    if name not in REFINED:
        return [best]
    kind, reach, low, high = REFINED[name]
    if kind == "factors":
        return list(FROM_ZERO[:points]) if best == 0 else sorted({max(low, best * f) for f in FACTORS})[:points]
    half = points // 2
    step = (reach / half if half else reach) if kind == "continuous" else max(1, reach // half) if half else reach
    around = [best + i * step for i in range(-half, half + 1)]
    clamped = [min(high, max(low, round(x, 4) if kind == "continuous" else int(x))) for x in around]
    return sorted(set(clamped))


def two_stage_search(df: DataFrame, numeric: list[str], categorical: list[str], label: str, ranges: dict[str, tuple | list], draws: tuple[int, int] = (60, 100), folds: tuple[int, int] = (3, 5), parallelism: int = 2, key: str | None = None, **parameters) -> PipelineModel:
    """Random search over wide ranges, then among refined values around the best, each by cross-validated mean absolute
    error; the second stage draws no more than there are combinations; ``parameters`` hold for all.  Folds are dealt by hash (of ``key``, or of the whole
    row) and written once for all draws of a stage."""
    checkpoints(df.sparkSession)
    dealt_by = F.xxhash64(*([key] if key else df.columns), F.lit(11))
    model = None
    for n, k in zip(draws, folds):
        rows = settle(df.withColumn("__fold", F.pmod(dealt_by, F.lit(k)).cast("int")))
        pipeline = boosted_trees(numeric, categorical, label, **parameters)
        regressor = pipeline.getStages()[-1]
        if all(isinstance(r, list) for r in ranges.values()):
            n = min(n, math.prod(map(len, ranges.values())))
        maps = draw_parameters(regressor, ranges, n)
        search = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, numFolds=k, parallelism=parallelism, foldCol="__fold", evaluator=RegressionEvaluator(labelCol=label, metricName="mae"))
        found = search.fit(rows)
        best = maps[min(range(n), key=lambda i: found.avgMetrics[i])]
        ranges = {p.name: refined(p.name, v) for p, v in best.items()}
        model = found.bestModel
    return model


def feature_importances(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """``feature, importance``, greatest first; absolute coefficients, or ones, where a model has no importances."""
    last = model.stages[-1]
    attributes = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    numeric = next((s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "__num"), [])
    names |= {i: c.removesuffix("__filled") for i, n in names.items() for k, c in enumerate(numeric) if n == f"__scaled_{k}"}
    size = len(names)
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficients"):
        values = [abs(x) for x in last.coefficients.toArray()]
    else:
        values = [1.0] * size
    rows = [(names.get(i, str(i)), float(v)) for i, v in enumerate(values)]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def mae_label(mae: Column) -> Column:
    return F.when(mae < 30, "excellent").when(mae < 60, "good").when(mae < 90, "fair").when(mae.isNotNull(), "poor")


def r2_label(r2: Column) -> Column:
    return F.when(r2 > 0.7, "excellent").when(r2 > 0.5, "good").when(r2 > 0.3, "fair").when(r2.isNotNull(), "poor")


def quality_labels(metrics: DataFrame, mae: str = "mae", r2: str = "r2") -> DataFrame:
    """``mae_quality, r2_quality`` and ``verdict``, the worse of both."""
    order = F.array(*[F.lit(x) for x in ("excellent", "good", "fair", "poor")])
    worse = F.greatest(F.array_position(order, F.col("mae_quality")), F.array_position(order, F.col("r2_quality")))
    out = metrics.withColumns({"mae_quality": mae_label(F.col(mae)), "r2_quality": r2_label(F.col(r2))})
    return out.withColumn("verdict", F.get(order, (worse - 1).cast("int")))


def compare_models(metrics: DataFrame, name: str = "model", error: str = "test_mae", order: str = "position") -> DataFrame:
    """Models by test error, ``best``, and how many percent better than the first of them (null if its error is 0)."""
    first = F.first(error).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = F.min(error).over(Window.partitionBy())
    return metrics.withColumns({"improvement": F.round(F.try_divide(100 * (first - F.col(error)), first), 6), "best": F.col(error) == best})


def save_model(model: PipelineModel, path: str, columns: list[str], metadata: dict) -> None:
    """The model and, beside it, a JSON line with its columns and whatever is to be known of it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"feature_columns": columns, "metadata": metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()["value"])
    missing = {"feature_columns", "metadata"} - about.keys()
    if missing:
        raise ValueError(f"no {sorted(missing)} with the model")
    return PipelineModel.load(f"{path}/model"), about


def batch_score(df: DataFrame, model: PipelineModel, columns: list[str], categories: list[str] | None = None) -> DataFrame:
    """Predictions for ``df``; a missing column is an error, unknown categories are ``unknown``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return model.transform(fill_categories(df, categories or []))
