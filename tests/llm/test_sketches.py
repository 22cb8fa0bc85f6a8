from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from rosterspark.llm import sketches


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_are_near_the_truth():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    for share in (0.0, 0.3, 0.8, 1.0):
        a = [rnd.choice(words) for _ in range(4000)]
        b = a[: int(4000 * share)] + [rnd.choice(words) for _ in range(4000 - int(4000 * share))]
        a, b = " ".join(a), " ".join(b)
        x, y, s, t = sketches.sketch(a), sketches.sketch(b), shingles(a), shingles(b)
        assert abs(sketches.resemblance(x, y) - len(s & t) / len(s | t)) < 0.15
        assert abs(sketches.containment(x, y) - len(s & t) / len(s)) < 0.25
        assert abs(sketches.distinct(x) / len(s) - 1) < 0.3


def test_merging_and_text_form():
    rnd = random.Random(2)
    text = [" ".join(rnd.choice("abcdefghij") for _ in range(300)) for _ in range(3)]
    parts = [sketches.sketch(t) for t in text]
    once = sketches.merge(sketches.merge(parts[0], parts[1]), parts[2])
    assert np.array_equal(once, sketches.merge(parts[0], sketches.merge(parts[2], parts[1])))
    assert np.array_equal(sketches.from_text(sketches.as_text(once)), once) and len(once) == sketches.K
    assert np.array_equal(sketches.from_text(""), np.empty(0, np.uint64))
    few = sketches.sketch("one two three four five six seven")
    assert sketches.distinct(few) == 3 and sketches.resemblance(few, few) == 1.0
    assert sketches.resemblance(sketches.sketch(""), sketches.sketch(None)) == 1.0
    assert sketches.resemblance(sketches.sketch(""), few) == 0.0


def test_merge_in_spark(spark):
    rnd = random.Random(3)
    text = [(i % 2, " ".join(rnd.choice("abcdefghij") for _ in range(400))) for i in range(6)]
    df = sketches.with_sketch(spark.createDataFrame([*text, (3, None)], "g int, text string"))
    got = {r["g"]: r["fingerprint"] for r in sketches.merge_sketches(df, ["g"]).collect()}
    for g in (0, 1):
        want = np.empty(0, np.uint64)
        for _, t in (x for x in text if x[0] == g):
            want = sketches.merge(want, sketches.sketch(t))
        assert got[g] == sketches.as_text(want)


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or ""), r[1] or ""))
    for r, n in zip(order, [*order[1:], order[0]]):
        t, u = r[1] or "", n[1] or ""
        half = len(t) // 2
        yield r[0], t, t[: len(t) - half] + u[:half], u


def test_edited_texts_in_one_range_and_in_many(docs, rows, empty):
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(sketches.resemblance(sketches.sketch(t), sketches.sketch(e)), 9), round(sketches.resemblance(sketches.sketch(t), sketches.sketch(u)), 9)) for i, t, e, u in edited(rows))
    for each in (10_000, 7):
        got = sketches.edited_pairs(docs, rows_each=each).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert sketches.edited_pairs(empty).count() == 0
    one = sketches.edited_pairs(docs.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_ids_of_other_types_and_hot_ids(spark, rows):
    for make in (lambda i: None if i is None else f"d-{i:04d}", lambda i: 7, lambda i: None):
        own = [(make(r[0]), r[1]) for r in rows]
        order = sorted(own, key=lambda r: (r[0] is not None, r[0] or "", signed(r[1] or ""), r[1] or "")) if make(1) != 7 else sorted(own, key=lambda r: (signed(r[1] or ""), r[1] or ""))
        want = []
        for r, n in zip(order, [*order[1:], order[0]]):
            t, u = r[1] or "", n[1] or ""
            e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            want.append((str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest()))
        kind = "string" if make(1) != 7 else "int"
        got = sketches.edited_pairs(spark.createDataFrame(own, f"doc_id {kind}, text string").repartition(3), rows_each=20).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_likeness_against_exact_sets(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 900)))) for i in range(80)]
    got = {r["doc_id"]: r for r in sketches.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t, e, u in edited(rows):
        s, x, y = shingles(t), shingles(e), shingles(u)
        r = got[i]
        assert abs(r["near_edited"] - len(s & x) / len(s | x)) < 0.15 and abs(r["near_next"] - len(s & y) / len(s | y)) < 0.1
        assert abs(r["n_shingles"] / len(s) - 1) < 0.3 and abs(r["held_by_edited"] - len(s & x) / len(s)) < 0.25
