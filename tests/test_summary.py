from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import summary


@pytest.mark.parametrize("shape", ["uniform", "ties", "skewed", "one value", "two"])
def test_exact_quantiles(spark, shape):
    rnd = random.Random(shape)
    make = {
        "uniform": lambda: rnd.random(),
        "ties": lambda: rnd.choice([0.0, 5.0, 5.0, 5.0, rnd.random() * 10]),
        "skewed": lambda: rnd.choice([-1.0, 1.0]) * 10.0 ** rnd.randint(-300, 300),
        "one value": lambda: 7.0,
        "two": lambda: rnd.choice([1.0, 2.0]),
    }[shape]
    values = [make() for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "x double").repartition(4)
    ranks = [1, 2, 1999, 2000, 2001, 4001]
    for few in (10_000, 5):
        for some in ([2001], [2000, 2001], ranks):
            assert summary.exact_quantiles(df, F.col("x"), some, narrow=0.01, few=few) == [sorted(values)[r - 1] for r in some]


def test_summaries(spark):
    rnd = random.Random(3)
    ages = [rnd.choice([None, rnd.randint(7000, 30000)]) for _ in range(501)]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    some = [a for a in ages if a is not None]
    r = summary.age_summary(df, "age").first()
    assert r["n"] == len(some) and r["median_days"] == statistics.median(some) and r["median_years"] == round(statistics.median(some) / 365.25, 6)
    assert summary.duration_summary(df, "age").first()["median"] == statistics.median(some)
    none = df.filter("age IS NULL")
    assert summary.age_summary(none, "age").first()["median_days"] is None and summary.duration_summary(none.filter("false"), "age").first()["share"] is None
    with pytest.raises(ValueError):
        summary.age_summary(df, "gone")


def test_no_buffer_holds_all_values(spark):
    plan = summary.duration_summary(spark.range(1000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
