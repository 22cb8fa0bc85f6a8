from __future__ import annotations

import math
import zlib

import pytest

from rosterspark.llm import quality


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, quality.score(docs, labels)


def test_held_out_accuracy(scored):
    docs, labels, out = scored
    joined = out.join(labels, "doc_id").select("held_out", "score", "predicted", "quality").collect()
    held = [r for r in joined if r["held_out"]]
    assert len(held) > 40
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in joined)


def test_fold(scored):
    for r in scored[2].select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_odd_rows(docs, empty, rows, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(70)] + [(5, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels)
    assert out.count() == len(rows) and out.filter("score is null").count() == 0
    assert quality.score(empty, labels).count() == 0
    none = quality.score(docs, labels.filter("false"))
    assert none.count() == len(rows) and none.select("score").distinct().count() == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_paths_of_a_tree():
    text = "T\n  If (feature 1 <= 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.0\n   Else (feature 0 > 2.0)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0\n"
    assert quality.paths(text) == [((1, True, 0.5),), ((0, True, 2.0), (1, True, 0.5)), ((0, False, 2.0), (1, True, 0.5)), ((1, False, 0.5),)]


def test_statistics_of_odd_texts():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == (0.0,) * len(quality.STATISTICS)
    s = dict(zip(quality.STATISTICS, quality.statistics("AB cd!! | 12.\n")))
    assert s["upper_word_share"] == 0.25 and s["lone_symbol_share"] == 0.25 and s["word_length"] == 2.5 and s["end_mark_share"] == 0.5


def test_compiled_rules_are_those_evaluated_by_hand(scored, spark):
    docs, labels, out = scored
    rules = quality.learn(docs, labels)
    assert rules.weights
    number = {n: i for i, n in enumerate(quality.STATISTICS)}
    assert len(number) == len(quality.STATISTICS)
    texts = docs.select("doc_id", "text").limit(200).collect()
    got = {r["doc_id"]: r["score"] for r in out.select("doc_id", "score").collect()}
    for r in texts:
        stats = quality.statistics(r["text"])
        total = rules.base
        for weight, tests in rules.weights:
            if all(stats[i] <= bound if below else stats[i] > bound for i, below, bound in tests):
                total += weight
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(i, t, f"s{i}") for i in range(40) for t in (f"plain words of text number {i} are here.", f"!! {i} ## @@ {i}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __stats string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one, two = (quality.learn(docs.repartition(n), labels) for n in (1, 3))
    assert one.base == pytest.approx(two.base) and [t for _, t in one.weights] == [t for _, t in two.weights]
    assert [w for w, _ in one.weights] == pytest.approx([w for w, _ in two.weights])
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.filter("__stats is null").count() == 0
