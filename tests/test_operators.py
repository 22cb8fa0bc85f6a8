from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rosterspark.functions import text
from rosterspark.operators import columns, filters, joins, match, modeling, quality, similar, summary, timeline
from rosterspark.sources import tables

D = datetime.date


def test_seat_timeline(spark):
    rows = [("A", "1", D(2000, 1, 1), D(2005, 1, 1)), ("A", "2", D(2004, 1, 1), None), ("B", "3", D(2001, 1, 1), D(2002, 1, 1)), (None, "4", D(2001, 1, 1), D(2009, 1, 1)), (None, "5", D(2002, 1, 1), None)]
    df = spark.createDataFrame(rows, "seat_id string, nid string, commission_date date, termination_date date")
    out = {r["nid"]: r["vacancy_date"] for r in timeline.seat_timeline(df).collect()}
    assert out == {"1": D(2004, 1, 1), "2": None, "3": D(2002, 1, 1), "4": D(2009, 1, 1), "5": None}
    assert timeline.predecessors(timeline.seat_timeline(df)).count() == 3
    with pytest.raises(ValueError):
        timeline.seat_timeline(df.drop("seat_id"))


def test_asof_takes_unknown_sequences_first(spark):
    noms = spark.createDataFrame([("n", D(2010, 5, 5)), ("n", D(1990, 1, 1)), (None, D(2010, 1, 1))], "nid string, receiveddate date")
    edu = spark.createDataFrame([("n", "BA", "x", 2000, 1), ("n", "JD", "y", 2005, 2), ("n", "LLM", "z", 2005, None), ("n", "late", "w", 2011, 3), (None, "no", "v", 2000, 1)], "nid string, degree string, school string, degree_year int, sequence int")
    got = {(r["nid"], r["receiveddate"].year): r["degree"] for r in joins.latest_education(noms, edu).collect()}
    assert got == {("n", 2010): "LLM", ("n", 1990): None, (None, 2010): None}
    service = spark.createDataFrame([("n", D(2009, 1, 1), "a", 5), ("n", D(2009, 1, 1), "b", 2), ("n", D(2009, 1, 1), "c", None), ("n", D(2020, 1, 1), "d", 1)], "nid string, nomination_date date, court string, sequence int")
    found = joins.nearest_service(noms, service, ["court"]).collect()
    assert len(found) == 3 and {r["fed_service_court"] for r in found} == {"b", None}


def test_partitioning_does_not_matter(spark):
    left = spark.range(200).selectExpr("id", "id % 5 as k", "id % 50 as t")
    right = spark.range(100).selectExpr("id as r", "id % 5 as k", "id % 40 as t")
    runs = []
    for n in (1, 7):
        out = joins.asof_backward(left.repartition(n), right.repartition(n), ["k"], "t", "t", "r", {"r": "r"})
        runs.append(sorted((x["id"], x["r"]) for x in out.collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 200


def test_intervals_out_of_range_are_null(spark):
    df = spark.createDataFrame([(D(1700, 1, 1),), (D(2001, 6, 6),), (None,)], "d date")
    out = {r["d"]: (r["pres_number"], r["senate_party"]) for r in joins.chambers_at(joins.president_at(df, "d"), "d").collect()}
    assert out == {D(1700, 1, 1): (None, None), D(2001, 6, 6): (43, "D"), None: (None, None)}


def test_crosswalk(spark):
    noms = spark.createDataFrame([("to be a judge, vice Ann Gray, retired",), ("succeeding Bo Hill.",), ("nobody",)], "description string")
    line = spark.createDataFrame([("S1", "j1"), ("S2", "j2")], "seat_id string, nid string")
    judges = spark.createDataFrame([("j1", "Ann", "Gray"), ("j2", "Robert", "Hill")], "nid string, first_name string, last_name string")
    out = {r["description"]: (r["seat_id"], r["seat_match_method"]) for r in match.crosswalk(noms, line, judges).collect()}
    assert out == {"to be a judge, vice Ann Gray, retired": ("S1", "predecessor_name"), "succeeding Bo Hill.": ("S2", "predecessor_name"), "nobody": (None, "unmatched")}
    seats = judges.withColumn("seat_id", F.when(F.col("nid") == "j1", "S2"))
    with_seats = {r["predecessor_nid"]: r["seat_id"] for r in match.crosswalk(noms, line, seats).collect()}
    assert with_seats == {"j1": "S2", "j2": "S2", None: None}


def test_empty_names_do_not_match(spark):
    schema = "citation string, first string, last string, mi string, receiveddate date"
    records = spark.createDataFrame([("c1", "", "", "", D(2000, 1, 1)), ("c2", "a", "b", "", D(2000, 1, 1))], schema)
    persons = spark.createDataFrame([("p1", "", "", ""), ("p2", "a", "b", "x")], "nid string, first string, last string, mi string")
    dates = spark.createDataFrame([], "nid string, nomination_date date")
    out = {r["citation"]: (r["nid"], r["match_confidence"]) for r in match.match_by_name_and_date(records, persons, dates).collect()}
    assert out == {"c1": (None, "no_match"), "c2": ("p2", "high_unambiguous")}


def test_uniqueness_and_profiles(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None), (None, "c")], "nid string, name string")
    assert tuple(quality.id_uniqueness(df, "nid").first()) == (False, 1)
    assert tuple(quality.id_uniqueness(df, "absent").first()) == (True, 0)
    assert {r["nulls"] for r in quality.null_profile(df).collect()} == {1}
    assert summary.bin_rare(spark.createDataFrame([("a",)] * 8 + [("b",), ("c",), (None,)], "x string"), "x", "y").groupBy("y").count().count() == 3


def test_columns_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "2000-01-05", "7.0", "x")], "`First Name` string, `Birth Date` string, `Birth Year` string, other string")
    tables.write_pipes(df, str(tmp_path / "p"))
    back = columns.coerce_by_name(columns.normalise_columns(tables.read_pipes(spark, str(tmp_path / "p"))))
    assert tuple(back.first())[1:] == (D(2000, 1, 5), 7, "x")
    saved = tables.write_catalog({"a": df.toDF("a", "b", "c", "d"), "none": df.toDF("a", "b", "c", "d").filter("false")}, str(tmp_path / "cat"))
    assert saved == ["a"] and tables.read_history(spark, str(tmp_path / "nothing")) is None
    assert tables.read_catalog(spark, str(tmp_path), ["p", "gone.csv"]).keys() == {"p"}
    with pytest.raises(ValueError):
        columns.drop_columns(df, ["gone"], strict=True)
    records = tables.typed_records(spark.createDataFrame([("5", "01/02/2003"), ("x", "")], "seat string, vacancy_date string")).collect()
    assert [tuple(r) for r in records] == [(5, D(2003, 1, 2)), (None, None)]


def test_filters_keep_nulls(spark):
    df = spark.createDataFrame([("Ambassador", "PN1-0"), ("ambassador", "PN2"), (None, None)], "description string, citation string")
    assert filters.drop_non_judicial(df).count() == 2 and filters.drop_dash_zero(df).count() == 2
    assert [r[0] for r in spark.createDataFrame([("Democrat",), ("Odd",), (None,)], "p string").select(text.party_code(F.col("p"))).collect()] == ["D", "Odd", None]


def test_similarity_in_blocks_is_the_same(spark):
    ref = spark.range(40).select(F.col("id").alias("ref_id"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("features"))
    asked = ref.filter("ref_id < 10").withColumnRenamed("ref_id", "query_id")
    for metric in similar.METRICS:
        one = sorted(map(tuple, similar.weighted_similarity(asked, ref, [1.0, 2.0], metric).collect()))
        many = sorted(map(tuple, similar.weighted_similarity(asked, ref, [1.0, 2.0], metric, most=3).collect()))
        assert one == many and len(one) == 400
    with pytest.raises(ValueError):
        similar.weighted_similarity(asked, ref, [1.0, 1.0], "other")


def test_models_are_saved_with_what_is_known_of_them(spark, tmp_path):
    rows = spark.range(120).selectExpr("id", "cast(id % 10 as double) as x", "if(id % 3 = 0, null, 'k' || (id % 2)) as c", "cast(id % 10 * 3 as double) as y")
    rows = columns.fill_categories(rows, ["c"])
    split = modeling.stratified_split(rows, "c", "id")
    assert split.filter("split = 'test'").count() == sum(-(-n // 5) for n in (40, 40, 40))
    model = modeling.boosted_trees(["x"], ["c"], "y", maxIter=3, maxDepth=2).fit(rows)
    modeling.save_model(model, str(tmp_path / "m"), ["x", "c"], {"note": 1})
    loaded, about = modeling.load_model(str(tmp_path / "m"))
    assert about["metadata"] == {"note": 1}
    scored = modeling.batch_score(rows, loaded, ["x", "c"], ["c"])
    assert scored.count() == 120 and modeling.feature_importances(loaded, scored).first()["feature"].startswith("x")
    with pytest.raises(ValueError):
        modeling.batch_score(rows.drop("x"), loaded, ["x", "c"])


def test_search_in_two_stages(spark):
    rows = spark.range(60).selectExpr("cast(id % 10 as double) as x", "'k' || (id % 2) as c", "cast(id % 10 * 3 as double) as y")
    model = modeling.two_stage_search(rows, ["x"], ["c"], "y", {"maxDepth": (1, 3), "stepSize": (0.05, 0.4)}, draws=(2, 1), folds=(2, 2), maxIter=5)
    assert summary.regression_metrics(model.transform(rows), "y", "prediction").first()["mae"] < 8


def test_flatten_keeps_all_items_where_no_most_is_given(spark):
    from rosterspark.functions.jsonx import flatten

    long = '{"a": [%s], "b": [{"c": [1, 2, 3]}, {"c": [4]}]}' % ", ".join(map(str, range(13)))
    df = spark.createDataFrame([(1, long), (2, '{"a": [7]}')], "id int, j string")
    ten, every = flatten(df, "j"), flatten(df, "j", most=None)
    assert sum(c.startswith("a_") for c in ten.columns) == 10 and sum(c.startswith("a_") for c in every.columns) == 13
    row = every.filter("id = 1").first()
    assert [int(row[f"a_{i}"]) for i in range(13)] == list(range(13)) and int(row["b_0_c_2"]) == 3 and int(row["b_1_c_0"]) == 4
    assert "b_0_c_3" not in every.columns


def test_empty_and_constant_inputs(spark):
    from rosterspark.operators import modeling, quality, summary, timeline

    empty = spark.createDataFrame([], "x double, y double")
    assert [(r["nulls"], r["null_percent"], r["mostly_null"]) for r in quality.null_profile(empty).collect()] == [(0, 0.0, False)] * 2
    assert [r["rate"] for r in quality.fill_rates(empty, ["x"]).collect()] == [None]
    assert summary.duration_summary(empty, "x").first()["share"] is None
    assert tuple(summary.regression_metrics(empty, "x", "y").first()) == (None, None)
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, y double")
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "x double, y double")
    assert tuple(summary.regression_metrics(same, "x", "y").first()) == (0.0, 1.0)
    assert tuple(summary.regression_metrics(off, "x", "y").first()) == (0.5, 0.0)
    models = spark.createDataFrame([("a", 0.0, 1), ("b", 2.0, 2)], "model string, test_mae double, position int")
    assert [r["improvement"] for r in modeling.compare_models(models).collect()] == [None, None]
    seats = spark.createDataFrame([("s", 2020, 13), ("s", 2019, 5), ("s", None, 4)], "seat_id string, source_year int, source_month int")
    assert tuple(timeline.latest_report_per_seat(seats).first()) == ("s", 2019, 5)


def test_missing_features_of_cases_count_as_the_mean_of_the_reference(spark):
    from rosterspark.operators.similar import most_similar_cases, top_similar

    train = spark.createDataFrame([(i, 100.0 + 9 * i, 1.0, float(i)) for i in range(10)], "id int, x double, z double, target double")
    query = spark.createDataFrame([(99, None, 1.0, 0.0)], "id int, x double, z double, target double")
    got = most_similar_cases(query, train, train.filter("false"), ["x", "z"], [1.0, 1.0], "target", metric="euclidean").first()
    assert got["id"] == 4 and got["_explanation"] == "z (1.000), x (0.500)"  # 140.5 is the mean: 4 (136) and 5 (145) are as near
    weights = spark.createDataFrame([("z", 0.25), ("other", 1.0)], "feature string, importance double")
    assert most_similar_cases(query, train, train.filter("false"), ["x", "z"], weights, "target").first()["_explanation"] == "z (0.250), x (0.000)"
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "ref_id int, features array<double>").repartition(3)
    asked = vectors.filter("ref_id < 11").withColumnRenamed("ref_id", "query_id")
    for metric in ("cosine", "euclidean", "manhattan"):
        one, many = (sorted(map(tuple, top_similar(asked, vectors, [1.0, 2.0], 4, metric, pivots=m).collect())) for m in (64, 3))
        assert [x[:2] + x[3:] for x in one] == [x[:2] + x[3:] for x in many] and len(one) == 44


def test_crosswalk_joins_each_nomination_once(spark):
    from rosterspark.operators.match import crosswalk

    noms = spark.createDataFrame([("a", "X, vice Ann Moss, retired."), ("a", "X, vice Ann Moss, retired."), ("b", "X, vice Bo Reed."), ("c", "no one"), ("d", "X, vice Cy Dale.")], "citation string, description string")
    judges = spark.createDataFrame([(1, "Ann", "Moss", "s1"), (2, "Bo", "Reed", "gone"), (3, "Cy", "Dale", None)], "nid int, first_name string, last_name string, seat_id string")
    line = spark.createDataFrame([("s1", 7), ("s1", 8), ("s2", 2), ("s3", 1)], "seat_id string, nid int")
    got = sorted(((r["citation"], r["seat_id"], r["timeline_nid"], r["seat_match_method"]) for r in crosswalk(noms, line, judges).collect()), key=str)
    assert got == sorted([("a", "s1", 7, "predecessor_name"), ("a", "s1", 8, "predecessor_name")] * 2 + [("b", "s2", 2, "predecessor_name"), ("c", None, None, "unmatched"), ("d", None, None, "unmatched")], key=str)
