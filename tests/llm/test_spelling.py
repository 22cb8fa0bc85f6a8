from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from rosterspark.llm import spelling as S


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, least=5, times=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    told = {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and near(w, x))
        form = close[0][1] if close and -close[0][0] >= times * n else None
        told[w] = (form, n, len(close), words[form] if form else None)
    out = []
    for w, (form, n, many, form_n) in told.items():
        root = w
        while told[root][0]:
            root = told[root][0]
        out.append((w, form, root, n, many, form_n))
    return sorted(out)


def texts(rnd, n):
    """Words of few letters, so that many are near, in very different numbers; chains of forms among them."""
    stems = ["".join(rnd.choices("abcé", k=rnd.randint(5, 9))) for _ in range(60)] + ["ÿ×÷àéî", "straße", "reading", "readings"]
    words = []
    for w in stems:
        for _ in range(4):
            i = rnd.randrange(len(w))
            words.append(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcz") + w[i:], w[:i] + rnd.choice("abcz") + w[i + 1 :], w]))
    weights = [6.0 ** rnd.randint(0, 4) for _ in words]
    make = lambda: "".join(w + rnd.choice([" ", "-", "7", "日", "Ā", "\n", "'"]) for w in rnd.choices(words, weights, k=rnd.randint(0, 80)))
    rows = [(i, rnd.choice([str.upper, str, str, str.title])(make())) for i in range(n)]
    return rows + [(None, make()), (n, None), (n + 1, ""), (n + 2, "x" * 40_000 + " " + "longestword" * 3)] + rows[:9]


def test_against_all_pairs(spark):
    rnd = random.Random(31)
    rows = texts(rnd, 700)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_hand(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    for sample, cell in ((100_000, 8192), (100_000, 16), (40, 8), (1, 4)):
        assert sorted((tuple(r) for r in S.spelling_variants(df, sample=sample, cell=cell).collect())) == want


def test_small_leaves_and_parts(spark, monkeypatch):
    rnd = random.Random(32)
    words = {"".join(rnd.choices("abc", k=rnd.randint(6, 8))) for _ in range(700)}
    monkeypatch.setattr(S, "LEAF", 4)
    monkeypatch.setattr(S, "BLOCK", 40)
    of = lambda length: sorted(w for w in words if len(w) == length)
    for a, b in ((6, 6), (6, 7), (7, 7), (7, 8)):
        x, y = of(a), of(b)
        got = sorted((x[i], y[j]) for p, q in S.near_pairs(S.numbers(x), S.numbers(y)) for i, j in zip(p, q))
        assert got == sorted((v, w) for v in x for w in y if near(v, w))


def test_words_are_dealt_to_all_cells_within_reach():
    rnd = random.Random(33)
    words = sorted({"".join(rnd.choices("abcdefé", k=8)) for _ in range(900)})
    counts = S.numbers(words).counts
    tree, cells = S.planes(counts[:200], 20)
    assert cells >= 10
    own = {int(r): c for c, rows in S.deal(tree, counts, 0) for r in rows}
    assert len(own) == len(words) == sum(len(rows) for _, rows in S.deal(tree, counts, 0))
    dealt = {(c, int(r)) for c, rows in S.deal(tree, counts, 2) for r in rows}
    apart = np.abs(counts[:, None].astype(int) - counts[None]).sum(-1)
    assert all((own[j], i) in dealt for i, j in zip(*np.nonzero(apart <= 2)))
    assert len(dealt) < cells * len(words)


def test_other_ids_extra_columns_and_empty_tables(spark, docs, rows, empty):
    assert sorted(tuple(r) for r in S.spelling_variants(docs).collect()) == by_hand([(r[0], r[1]) for r in rows])
    assert S.spelling_variants(empty).count() == 0
    named = [(f"d{i}", "Winter winter winted wintér " * 6, "w", 1) for i in range(5)]
    df = spark.createDataFrame(named, "doc_id string, text string, word string, n int")
    got = S.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand([(r[0], r[1]) for r in named])


def test_long_chains(spark):
    chain = [(f"word{i}", f"word{i + 1}") for i in range(1, 9)] + [("other", "word3")]
    got = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "word9" for w, _ in chain}
