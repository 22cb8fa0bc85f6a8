from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rosterspark.functions import calendar, description, jsonx, names, text
from rosterspark.sources.tables import parse_date


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


@pytest.fixture(autouse=True)
def _column(spark):
    """Columns need a running session."""
    globals()["X"] = F.col("x")


def test_dates_of_two_forms(spark):
    good, bad = ["1889-03-15", "1889-3-5", "03/15/1889", "3/5/1889", " 2001-01-02 "], ["", None, "no date", "32/03/1889", "1889-03-32", "1889-13-15"]
    d = datetime.date
    assert values(spark, good + bad, parse_date(X)) == [d(1889, 3, 15), d(1889, 3, 5), d(1889, 3, 15), d(1889, 3, 5), d(2001, 1, 2)] + [None] * 6


def test_predecessors(spark):
    cases = {
        ", vice mary l. gray, retiring": "mary l. gray",
        " vice Paul B. Stone,jr., retired.": "Paul B. Stone,jr.",
        "x vice Thomas A. Reed, Jr., elevated": "Thomas A. Reed, Jr.",
        " vice a new position created by p. l. 101-650": "a new position created by public law 101-650",
        "advice only": None,
        "": None,
        None: None,
    }
    assert values(spark, list(cases), text.predecessor(X)) == list(cases.values())


def test_reasons(spark):
    cases = {"vice A B, retired": "Retirement", "vice A B, elevated.": "Elevated", "vice a new position created by law": "New Position", "A B, retired": None, "vice A B.": None, "vice A B, no senate vote": "No senate vote"}
    assert values(spark, list(cases), text.vacancy_reason(X)) == list(cases.values())


def test_names(spark):
    cases = {
        "Gray, Mary": "Mary Gray",
        "Stone, Paul Bert": "Paul Bert Stone",
        "Reed, Thomas, Jr.": "Thomas Reed Jr.",
        "Pond, Simon Todd III": "Simon Todd Pond III",
        "pond, simon todd iii": "simon todd pond iii",
        "Hill, Ana Jr., PhD": "Ana Hill Jr., PhD",
        "": "",
        None: "",
        "Single Name": "Single Name",
    }
    assert values(spark, list(cases), names.first_then_last(X)) == list(cases.values())
    parts = names.name_parts(X)
    got = values(spark, ["John Quincy Smith, Jr.", "Judge Ann Lee", "Plato", None, "de la Cruz, José M."], parts["first"], parts["middle"], parts["last"], parts["suffix"])
    assert got == [("John", "Quincy", "Smith", "Jr."), ("Ann", None, "Lee", None), ("Plato", None, None, None), (None, None, None, None), ("José", "M.", "de la Cruz", None)]


def test_court_codes(spark):
    parts = text.circuit_court(X)
    got = values(spark, ["09 - CA-N", "DC - DC", "03 - FED", "1 - CA", "IT", "CL - ", "FD - CCA", "", None, "Odd Form", "XX - YY", "14 - CA"], parts["circuit"], parts["court"], parts["is_valid"])
    assert got == [(9, "CA-N", True), (None, "DC", True), (3, "FED", True), (1, "CA", True), (None, "IT", True), (None, "CL", True), (13, "CCA", True), (None, "", False), (None, None, False), (None, "Odd Form", False), (None, "XX - YY", False), (None, "14 - CA", False)]


def test_descriptions(spark):
    cases = [
        ("Ann Gray, of Ohio, to be United States District Judge for the Northern District of Ohio, vice Bea Hill, retired.", ("Ann Gray", "Ohio", "United States District Judge", "Northern District of Ohio", "Bea Hill", "retired", None, "high")),
        ("Ann Gray, of the District of Columbia, to be an Associate Judge of the Superior Court of the District of Columbia for the term of fifteen years, vice Wendy P. Moor, Jr., retired.", ("Ann Gray", "District of Columbia", "Associate Judge", "Superior Court of the District of Columbia", "Wendy P. Moor, Jr.", "retired", None, "high")),
        ("Ann Gray, of Iowa, to be a Judge of the United States Court of Federal Claims for a term of fifteen years, vice Reg W. Dale, retired.", ("Ann Gray", "Iowa", "Judge", "United States Court of Federal Claims", "Reg W. Dale", "retired", "fifteen years", "high")),
        ("Ann Gray, of Utah, to be United States Magistrate Judge for the District of Utah for a term of eight years.", ("Ann Gray", "Utah", "United States Magistrate Judge", "District of Utah", None, None, "eight years", "high")),
        ("Ann Gray, of New York,to be United States Circuit Judge for the Second Circuit, vice Joe M. Lane, retired.", ("Ann Gray", "New York", "United States Circuit Judge", "Second Circuit", "Joe M. Lane", "retired", None, "high")),
        ("Ann Gray, of Maine, to be an Associate Judge of the District of Columbia Court of Appeals for the term of fifteen years, vice Stan S. Hart.", ("Ann Gray", "Maine", "Associate Judge", "District of Columbia Court of Appeals", "Stan S. Hart", None, None, "high")),
        ("Ann Gray, of Maine, to the United States District Judge for the District of Maine vice Bob M. Wall, Jr., elevated.", ("Ann Gray", "Maine", "United States District Judge", "District of Maine", "Bob M. Wall, Jr.", "elevated", None, "high")),
        ("Nothing of the kind", (None, None, None, None, None, None, None, "failed")),
        ("  ", (None, None, None, None, None, None, None, "failed")),
        (None, (None, None, None, None, None, None, None, "failed")),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, description string")
    fields = ["nominee_name", "nomination_of_or_from_location", "nomination_to_position_title", "nomination_to_court_name", "nomination_predecessor_name", "nomination_vacancy_reason", "nomination_term_info", "nomination_parsing_confidence"]
    got = description.parse_descriptions(df).orderBy("i").select(*fields).collect()
    assert [tuple(r) for r in got] == [want for _, want in cases]


def test_lists_of_nominees(spark):
    df = spark.createDataFrame([("The following-named persons to be members of the Board for a term of six years: Ann Gray, of Ohio Bea Hill, of Iowa",)], "description string")
    r = description.parse_descriptions(df).first()
    assert r["nomination_is_list_nomination"] and r["nomination_parsing_confidence"] == "medium" and r["nomination_multiple_nominees_count"] == 1


def test_elections_and_terms(spark):
    days = ["2010-11-02", "2021-11-02", "2022-11-08", "2024-11-05"]
    assert values(spark, days, calendar.election_day(F.year(X.cast("date")))) == [datetime.date.fromisoformat(d) for d in days]
    start = F.lit("2009-01-20").cast("date")
    assert values(spark, ["2013-01-19", "2013-01-20", "2009-01-20", "2008-01-01"], calendar.term_index(X.cast("date"), start)) == [1, 2, 1, None]
    assert values(spark, ["2024-11-05", "2024-11-06"], calendar.days_to_presidential_election(X.cast("date"))) == [0, 1462]


def test_flattening(spark):
    rows = [(1, '{"a": {"b": 1}, "l": [{"x": "p"}, {"x": "q"}]}'), (2, '{"a": {"b": 2}, "c": "z", "l": []}'), (3, "not json")]
    out = jsonx.flatten(spark.createDataFrame(rows, "i int, j string"), "j").orderBy("i").collect()
    assert [(r["a_b"], r["c"], r["l_0_x"], r["l_1_x"], r["j"]) for r in out] == [(1, None, "p", "q", rows[0][1]), (2, "z", None, None, rows[1][1]), (None, None, None, None, "not json")]


def test_lenient_json(spark):
    got = values(spark, ["{'a': True, 'b': None}", '{"a": 1}', "odd", None], jsonx.lenient(X))
    assert got[1] == '{"a": 1}' and got[2] == got[3] == "{}" and '"a": true' in got[0].replace("'", '"')
