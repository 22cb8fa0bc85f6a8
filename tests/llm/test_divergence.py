from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from rosterspark.llm import divergence as D


def by_hand(rows, least=30, terms=50):
    """Shares, differences and ranks from dense tables."""
    uses, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        uses[lang, source].update(found)
        uses[lang].update(found)
        holds[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, d in holds[lang].items() if d >= least)

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = share(uses[lang, source])
        pairs = []
        for lang_, peer in groups:
            if lang_ == lang and peer != source:
                other = share(uses[lang, peer])
                pairs.append((sum(abs(own[t] - other[t]) for t in kept), peer))
        every = share(uses[lang])
        above = [(own[t] - every[t], t) for t in kept if uses[lang, source][t] and own[t] > every[t]]
        for part, items, most in (("pair", pairs, None), ("term", above, terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def table(rnd, n):
    words = [f"{a}{b}" for a in "abcdeé日" for b in ("ba", "co", "Du", "x" * 30)] + ["İ", "ǅ", "ß"]
    lang = lambda: rnd.choice(["en", "en", "en", "de", None, ""])
    source = lambda: rnd.choice(["s1", "s1", "s1", "S2", "é", None, "", "z𝄞"])
    text = lambda: None if rnd.random() < 0.05 else "".join(w + rnd.choice(" -\n9\x7f_") for w in rnd.choices(words, k=rnd.randint(0, 40)))
    rows = [(lang(), source(), text()) for _ in range(n)]
    rows += [("fr", "few", "un deux trois"), ("fr", "none", None), ("it", "alone", "x"), ("en", "empty", "")]
    return rows + rows[:20]


def test_against_dense_tables(spark, monkeypatch):
    rnd = random.Random(9)
    rows = table(rnd, 500)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = by_hand(rows)
    assert len({r[2] for r in want}) == 2 and any(r[4] == 0 for r in want)
    for held, few, at_once in ((400_000, 1 << 15, 1024), (10, 20, 2)):
        monkeypatch.setattr(D, "HELD", held)
        monkeypatch.setattr(D, "FEW", few)
        monkeypatch.setattr(D, "MANY", few)
        monkeypatch.setattr(D, "ROWS", at_once)
        assert sorted(tuple(r) for r in D.divergence(df).collect()) == want
    few = D.divergence(df, least=5, terms=3)
    assert sorted(tuple(r) for r in few.collect()) == by_hand(rows, 5, 3)


def test_all_kinds_of_rows(docs, rows, empty):
    got = sorted(tuple(r) for r in D.divergence(docs, least=2).collect())
    assert got == by_hand([(r[2], r[3], r[1]) for r in rows], 2)
    assert D.divergence(empty).count() == 0
    assert D.divergence(docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_columns_with_clashing_names(spark):
    rows = [("a b c", "en", s, 1, 2, 3) for s in ("x", "y") for _ in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string, source string, n int, term int, who int")
    assert sorted(tuple(r) for r in D.divergence(df).collect()) == by_hand([(r[1], r[2], r[0]) for r in rows])


def test_accumulators_against_dense_differences():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s, v = int(rng.integers(1, 8)), int(rng.integers(1, 40))
        n = rng.integers(0, 4, (s, v)) * (rng.random((s, v)) < 0.5)
        total = n.sum(1) + 5 * v
        p, absent = 1 + 10**9 * (n + 5) // total[:, None], 1 + 10**9 * 5 // total
        who, term = np.nonzero(n)
        codes = np.unique(term, return_inverse=True)[1]
        cut = s // 2
        got = np.vstack([D._accumulate(codes, who, p[who, term], absent, a, b) for a, b in ((0, cut), (cut, s))])
        used = n.sum(0) > 0
        want = np.abs(p[:, None, used] - p[None, :, used]).sum(-1)
        assert (got == want)[~np.eye(s, dtype=bool)].all()


def test_counts_beyond_a_long_in_the_product(spark):
    from pyspark.sql import functions as F

    n, total, terms = 10**15 + 3, 7 * 10**15, 10**6
    got = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
