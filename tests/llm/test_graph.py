from __future__ import annotations

import random

import pytest

from rosterspark.llm import graph, quality


@pytest.fixture
def many_partitions(spark):
    """A session that deals every shuffle to 60 partitions and leaves them as they are."""
    own = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def least_reachable(edges):
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_components_by_either_way(spark, monkeypatch, small):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(-40, 0)] + [(1000, i) for i in range(1001, 1100)]
    edges += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    rnd.shuffle(edges)
    monkeypatch.setattr(graph, "SMALL", small)
    frame = spark.createDataFrame([*edges, edges[0], (7, 7), (None, 3)], "a long, b long")
    got = [tuple(r) for r in graph.connected_components(frame).collect()]
    want = least_reachable([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and dict(got) == want
    assert graph.connected_components(frame.filter("a = 7")).count() == 0


def test_small_graphs_take_few_partitions(spark, many_partitions):
    """Whatever the number of shuffle partitions: tasks and files of a round are not mostly empty ones."""
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 400)], "a long, b long")
    assert graph.connected_components(edges).rdd.getNumPartitions() <= 2 * graph.FEW


def test_fits_take_few_partitions(spark, monkeypatch):
    """Each of some hundred passes of a fit takes a task a partition, also where the session deals to more than asked."""
    frame = type(spark.range(0))
    plain, seen = frame.repartition, []
    monkeypatch.setattr(frame, "repartition", lambda self, n, *columns: plain(self, max(n, 60), *columns))
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows.rdd.getNumPartitions()) or quality.Rules(0.0))
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(300)], "doc_id long, text string")
    quality.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert seen and seen[0] <= 4
