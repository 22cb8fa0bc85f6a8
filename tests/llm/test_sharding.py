from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rosterspark.llm.sharding import descend, shard_documents, topology


def test_contract(docs, rows, empty):
    got = shard_documents(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in got:
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"] and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    assert shard_documents(empty).count() == 0


def plain(key, leaves, per_rack=5, racks=4, most=1.0):
    """The descent for one key, in whole numbers."""
    mask = (1 << 64) - 1

    def draw(region, arrival, what):
        x = (key + ((region * 0x1000003 + arrival) * 2 + what + 1) * 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    at = {(r, k % racks, s % per_rack): (s, w) for r, k, s, w in leaves}
    found = []
    for region in sorted({r for r, *_ in leaves}):
        time = 0.0
        for arrival in range(10_000):
            time -= math.log(((draw(region, arrival, 0) >> 11) + 0.5) / 2**53) / (racks * per_rack * most)
            low = draw(region, arrival, 1)
            shard, weight = at.get((region, (low >> 48) * racks >> 16, (low >> 32 & 0xFFFF) * per_rack >> 16), (None, 0))
            if ((low & 0xFFFFFFFF) + 0.5) / 2**32 * most < weight:
                found.append((time, shard))
                break
    return min(found)[1]


def test_descent_is_that_of_single_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    for leaves, most in ((topology(40), 1.0), (topology(41), 1.0), (topology(7, weights={2: 0.25, 3: 3.0}), 4.0)):
        assert descend(keys, leaves, most=most).tolist() == [plain(int(k), leaves, most=most) for k in keys]


def test_growth_and_weights():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 40_000).astype(np.uint64)
    grown = {n: descend(keys, topology(n)) for n in (20, 21, 39, 40, 41, 42)}
    for a, b in ((20, 21), (39, 40), (40, 41), (41, 42)):
        moved = grown[a] != grown[b]
        assert moved.any() and (grown[b][moved] == b - 1).all()
        assert abs(moved.mean() * b - 1) < 0.2
    sizes = np.bincount(grown[40], minlength=40)
    assert len(sizes) == 40 and sizes.min() > 850 and sizes.max() < 1150
    # a rack (shards 5 to 9) gets heavier, then lighter: nothing moves but into it, or out of it
    inside = lambda s: (s >= 5) & (s < 10)
    light, usual, heavy = (descend(keys, topology(40, weights={s: w for s in range(5, 10)}), most=2.0) for w in (0.25, 1.0, 2.0))
    for less, more in ((light, usual), (usual, heavy)):
        moved = less != more
        assert moved.any() and inside(more[moved]).all() and not inside(less[moved]).all()
    assert abs(inside(heavy).mean() - 10 / 45) < 0.02 and abs(inside(light).mean() - 1.25 / 36.25) < 0.01
    gone = descend(keys, topology(40, weights={3: 0.0}))
    assert not (gone == 3).any() and (grown[40][gone != grown[40]] == 3).all()
    with pytest.raises(ValueError):
        descend(keys, topology(3, weights={1: 2.0}))


def test_slots_of_equal_ids_are_settled(spark):
    rows = [(7, t) for t in ("b", "aa", "c", "b", "", None)] * 20
    one, two = (shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect() for n in (1, 5))
    of = lambda out: sorted((r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in out)
    assert of(one) == of(two)
