"""Scans in order, whole and in ranges, against plain Python."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import joins, ordered, timeline

DAY = datetime.date(2000, 1, 1)


def rows_of(rnd, n=600):
    """A key with most rows, small ones and none; equal times, equal rows, unknown values."""
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    rows = [(i, key(), rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)])) for i in range(n)]
    return rows + rows[:30]


def scan(rows, order):
    """Row, previous, next, least so far, last so far, first to come for each row with a key, in order; others alone."""
    out = []
    for k in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == k), key=order)
        for one in [[r] for r in own] if k is None else [own]:
            least = last = None
            for i, r in enumerate(one):
                v = r[3]
                least = v if least is None or (v is not None and v < least) else least
                last = v if v is not None else last
                coming = next((x[3] for x in one[i:] if x[3] is not None), None)
                out.append((*r, one[i - 1][3] if i else None, one[i + 1][3] if i + 1 < len(one) else None, least, last, coming))
    return sorted(out, key=repr)


@pytest.mark.parametrize("each", [10_000, 50, 7])
def test_scans(spark, each):
    rows = rows_of(random.Random(each))
    df = spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(5)
    v = F.col("v")
    got = ordered.scanned(df, ["k"], [F.col("t"), F.col("id")], {"prev": v}, {"next": v}, {"least": v}, {"last": v}, {"coming": v}, rows_each=each)
    assert got.columns == ["id", "k", "t", "v", "prev", "next", "least", "last", "coming"]
    assert sorted(map(tuple, got.collect()), key=repr) == scan(rows, lambda r: (r[2] is not None, r[2] or 0, r[0]))


def test_a_hot_key_is_spread_in_order(spark):
    rows = [(i, "hot", i // 3, i) for i in range(5000)] + [(i, "cold", i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(6)
    dealt = ordered.in_ranges(df, ["k"], [F.col("t")], 100)
    sizes = dealt.groupBy("k", "__range").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("k", "__range").collect()
    hot = [r for r in sizes if r["k"] == "hot"]
    assert len(hot) >= 25 and max(r["n"] for r in hot) <= 500 and sum(r["n"] for r in hot) == 5000
    assert all(x["b"] <= y["a"] for x, y in zip(hot, hot[1:]))
    assert [(r["__range"], r["n"]) for r in sizes if r["k"] == "cold"] == [(0, 40)]
    assert ordered.in_ranges(df, ["k"], [F.col("t")], 5000) is None
    # rows that are equal in everything are spread too
    same = spark.range(900).select(F.lit("k").alias("k"), F.lit(1).alias("t"))
    assert ordered.in_ranges(same, ["k"], [F.col("t")], 100).groupBy("__range").count().agg(F.max("count")).first()[0] <= 300


def test_rows_without_a_key_do_not_meet(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 10, F.col("id")).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    got = ordered.scanned(df, ["k"], [F.col("t")], before={"p": F.col("v")}, rows_each=20)
    assert got.filter("p IS NOT NULL").count() == 0 and got.count() == 3000
    left = df.select("k", "t")
    found = joins.asof_backward(left, df, ["k"], "t", "t", "v", {"v": "v"})
    # of rows without a key no task has more than its share
    spread = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert found.count() == 3000 and spread < 2500


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_in_ranges_is_the_same(spark, strict):
    rnd = random.Random(int(strict))
    left = [(i, rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(60)])) for i in range(400)]
    right = [(rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(60)]), rnd.choice([None, 1, 2]), i) for i in range(300)]
    want = []
    for i, k, t in left:
        best = [(u, n is not None, n or 0, r) for q, u, n, r in right if k is not None and q == k and t is not None and u is not None and (u < t if strict else u <= t)]
        want.append((i, max(best)[3] if best else None))
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "k string, u int, n int, r int").repartition(3)
    for each in (10_000, 9):
        got = joins.asof_backward(a, b, ["k"], "t", "u", "n", {"r": "r"}, strict, rows_each=each)
        assert sorted(map(tuple, got.select("id", "r").collect()), key=repr) == sorted(want, key=repr)
    # the best by another order than time
    want = []
    for i, k, t in left:
        best = [(n is not None, n or 0, r) for q, u, n, r in right if k is not None and q == k and t is not None and u is not None and u <= t]
        want.append((i, min(best)[2] if best else None))
    for each in (10_000, 9):
        got = joins.asof_best(a, b, ["k"], "t", F.col("u"), [F.col("n")], {"r": "r"}, rows_each=each)
        assert sorted(map(tuple, got.select("id", "r").collect()), key=repr) == sorted(want, key=repr)
    assert joins.asof_best(a, b.filter("false"), ["k"], "t", F.col("u"), [F.col("n")], {"r": "r"}).filter("r IS NULL").count() == 400
    assert joins.asof_backward(a.filter("false"), b, ["k"], "t", "u", "n", {"r": "r"}).count() == 0


def test_timelines_in_ranges_are_the_same(spark):
    rnd = random.Random(5)
    day = lambda: rnd.choice([None, *[DAY + datetime.timedelta(rnd.randint(0, 300)) for _ in range(9)]])
    rows = [(rnd.choice(["S01", "S01", "S01", "S02", None]), i, day(), day()) for i in range(500)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "seat_id string, nid int, commission_date date, termination_date date").repartition(4)
    whole, parts = timeline.seat_timeline(df), timeline.seat_timeline(df, rows_each=11)
    assert whole.columns == parts.columns == [*df.columns, "vacancy_date"]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    assert whole.filter("seat_id IS NULL AND NOT vacancy_date <=> termination_date").count() == 0
    own = [timeline.succession(df, "seat_id", "commission_date", "termination_date", ["nid"], rows_each=n) for n in (10**6, 13)]
    assert sorted(map(repr, own[0].collect())) == sorted(map(repr, own[1].collect()))
    assert own[0].filter("seat_id IS NULL AND (gap_days IS NOT NULL OR succession != 'regular')").count() == 0


@pytest.mark.parametrize("each", [10**6, 2])
def test_ties_of_succession_go_by_all_columns(spark, each):
    day = lambda n: None if n is None else DAY + datetime.timedelta(n)
    # of one seat, start and number: the earlier end is first; unknown numbers, ends and starts are last
    rows = [("S", 1, 5, 15), ("S", 1, 5, 8), ("S", 1, 5, None), ("S", None, 5, 40), ("S", 2, 5, 20), ("S", 3, 50, 60), ("S", 4, None, 70)]
    want = [(1, 8, None), (1, 15, -3), (1, None, -10), (2, 20, None), (None, 40, -15), (3, 60, 10), (4, 70, None)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame([(s, n, day(a), day(b)) for s, n, a, b in some], "seat string, nid int, a date, b date").coalesce(1)
        got = timeline.succession(df, "seat", "a", "b", ["nid"], rows_each=each)
        found = [(r["nid"], r["b"], r["gap_days"]) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(((n, day(b), gap) for n, b, gap in want), key=repr)


def test_duplicates_without_sorting_keys(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None, 4, 5]), rnd.randint(0, 5), i % 50) for i in range(300)] + [(9, 1, 1)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "k int, t int, v int").repartition(5)
    for most in (1, 7, 20, 1000):
        want = []
        for k in sorted({r[0] for r in rows}, key=lambda x: (x is not None, x or 0)):
            want += sorted(r for r in rows if r[0] == k) [1:]
        got = timeline.duplicate_report(df, ["k"], [F.col("t")], most)
        assert [tuple(r) for r in got.collect()] == want[:most]
    plan = timeline.duplicate_report(df, ["k"], [F.col("t")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "GlobalLimit 41" in plan


def test_ties_of_newest_rows_go_by_all_columns(spark):
    payloads = spark.createDataFrame([("p", "q", DAY, 2), ("p", "q", DAY, 1), ("p", "q", None, 4), ("p", "q", None, 3)], "payload string, request string, retrieval_date date, n int")
    assert [r["n"] for r in timeline.latest_payloads(payloads, "payload").collect()] == [3]
    reports = spark.createDataFrame([("s", 2000, 5, "b"), ("s", 2000, 5, "a"), ("s", 2000, 13, "0")], "seat_id string, source_year int, source_month int, x string")
    assert [r["x"] for r in timeline.latest_report_per_seat(reports).collect()] == ["a"]
