"""Matching by name and date against all pairs."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest

from rosterspark.operators import match

DAY = datetime.date(2000, 1, 1)


def tables(rnd, records=150, persons=60):
    first, last, mi = (lambda: rnd.choice(["ann", "ann", "bea", "", None])), (lambda: rnd.choice(["gray", "gray", "hill", ""])), (lambda: rnd.choice(["", "a", "b", None]))
    day = lambda: None if rnd.random() < 0.1 else DAY + datetime.timedelta(rnd.randint(0, 400))
    who = [(i, first(), last(), mi()) for i in range(persons)] + [(900, "solo", "one", "x"), (900, "solo", "one", "y"), (None, "ann", "gray", "a")]
    when = [(rnd.choice([None, *range(persons)]), day()) for _ in range(persons * 2)] + [(900, DAY)]
    what = [(rnd.choice([None, *range(records)]), first(), last(), mi(), day()) for _ in range(records)] + [(1000, "solo", "one", "", None), (1000, "no", "body", "", DAY)]
    return what, who, when


def by_pairs(what, who, when, window):
    out = {}
    for record in {r[0] for r in what} - {None}:
        own = [r for r in what if r[0] == record and r[1] and r[2]]
        pairs = [(p[0], r[3], p[3]) for r in own for p in who if p[0] is not None and p[1:3] == r[1:3]]
        if len({p[0] for p in pairs}) == 1:
            out[record] = (pairs[0][0], "high_unambiguous")
        elif pairs:
            days = [r[4] for r in own if r[4]]
            gaps = [(abs((d - min(days)).days), p[0]) for p in pairs for q, d in when if q == p[0] and d] if days else []
            gaps = [g for g in gaps if g[0] <= window]
            same = [p[0] for p in pairs if p[1] and p[1] == p[2]]
            if gaps:
                out[record] = (min(gaps)[1], "high_date_resolved")
            elif same:
                out[record] = (min(same), "medium_mi_resolved")
    return Counter((r[0], *out.get(r[0], (None, "no_match"))) for r in what)


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    what, who, when = tables(random.Random(seed))
    records = spark.createDataFrame(what, "citation int, first string, last string, mi string, receiveddate date").repartition(3)
    persons = spark.createDataFrame(who, "nid int, first string, last string, mi string")
    dates = spark.createDataFrame(when, "nid int, nomination_date date")
    for window, each in ((3, 10**6), (40, 11)):
        got = match.match_by_name_and_date(records, persons, dates, window=window, rows_each=each)
        assert Counter(tuple(r) for r in got.select("citation", "nid", "match_confidence").collect()) == by_pairs(what, who, when, window)


def test_a_name_of_many_costs_what_it_holds(spark):
    n = 30_000
    records = spark.range(n).selectExpr("id as citation", "'ann' as first", "'gray' as last", "'' as mi", "date_add(date'1950-01-01', cast(id % 9000 as int)) as receiveddate")
    persons = spark.range(n).selectExpr("id as nid", "'ann' as first", "'gray' as last", "'' as mi")
    dates = spark.range(n).selectExpr("id as nid", "date_add(date'1950-01-01', cast(id % 9000 as int)) as nomination_date")
    out = match.match_by_name_and_date(records, persons, dates, window=5)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    # nine thousand days, on each of which the least id wins
    assert out.filter("nid = citation % 9000 AND match_confidence = 'high_date_resolved'").count() == n


def test_empty_tables(spark):
    what, who, when = tables(random.Random(1))
    records = spark.createDataFrame(what, "citation int, first string, last string, mi string, receiveddate date")
    persons = spark.createDataFrame(who, "nid int, first string, last string, mi string")
    dates = spark.createDataFrame(when, "nid int, nomination_date date")
    none = match.match_by_name_and_date(records, persons.filter("false"), dates)
    assert none.filter("match_confidence = 'no_match' AND nid IS NULL").count() == len(what)
    assert match.match_by_name_and_date(records.filter("false"), persons, dates).count() == 0
    assert match.match_by_name_and_date(records, persons, dates.filter("false")).filter("match_confidence = 'high_date_resolved'").count() == 0
