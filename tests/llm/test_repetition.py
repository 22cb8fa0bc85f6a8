from __future__ import annotations

import random
import re

import numpy as np
import pytest

from rosterspark.llm import repetition as R


def by_hand(text, least):
    """Covered code points and longest repeat from sorted suffixes."""
    n, order = len(text), sorted(range(len(text)), key=lambda i: text[i:])
    deepest = [0] * n
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        deepest[a], deepest[b] = max(deepest[a], k), max(deepest[b], k)
    spans = [(i, k) for i, k in enumerate(deepest) if k >= least]
    return len({j for i, k in spans for j in range(i, i + k)}), max((k for _, k in spans), default=0)


def together(texts):
    every = [R.code_points(t) for t in texts]
    return np.concatenate(every), np.cumsum([len(c) for c in every])


def test_suffixes_and_repeats_against_sorted_suffixes():
    rnd = random.Random(5)
    for _ in range(250):
        least, texts = rnd.choice([1, 2, 3, 5, 8]), []
        for _ in range(rnd.randint(1, 6)):
            letters = rnd.choice(["ab", "a", "abc", "aé日𝄞", "abcdefghij \0"])
            texts.append("".join(rnd.choices(letters, k=rnd.randint(0, 50))) * rnd.choice([1, 1, 1, 4]))
        codes, ends = together(texts)
        starts = [0, *ends[:-1]]
        assert R.suffix_array(codes, ends).tolist() == [s + i for s, t in zip(starts, texts) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        got = R.repeats(codes, ends, least)
        assert list(zip(got.covered, got.longest)) == [by_hand(t, least) for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, "abcdefg" * 30_000])
def test_a_long_text_that_repeats_throughout(text):
    period = (text + text).find(text, 1)
    got = R.repeats(*together([text]))
    assert (got.covered[0], got.longest[0]) == (len(text), len(text) - period)


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if twice is None:
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = len({j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)})
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), again, len(words) < 10 or 100 * again > 20 * len(words)


def test_all_kinds_of_rows(spark, docs, rows, empty):
    extra = ["a b\n a b\na b\n\n \n", "x|y <z> #1 $2 50% * &" * 3, "one two three four five six one two three four five", "日本 語 x\u0085y z " * 4, None, "-".join(["nowhitespaceatall"] * 300)]
    more = spark.createDataFrame([(1000 + i, t, 1, 2) for i, t in enumerate(extra)], "doc_id long, text string, n_words int, kept int")
    got = [*R.repetition(docs).collect(), *R.repetition(more).collect()]
    texts = [(r[0], r[1] or "") for r in rows] + [(1000 + i, t or "") for i, t in enumerate(extra)]
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(i), *base(t)) for i, t in texts)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in texts:
        r = by_id[i]
        if i is not None and len(t) < 3000:
            assert (r["n_repeat_chars"], r["longest_repeat"]) == by_hand(t, R.LEAST)
        assert not (r["kept"] and r["base_failed"])
    assert R.repetition(empty).count() == 0 and R.repetition(empty).columns == R.repetition(docs).columns


def test_verdict(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(n))
    clean, line, block = words(400), words(12), words(60)
    texts = {
        "clean": clean,
        "one line twice": f"{clean}\n{line}\n{words(100)}\n{line}",
        "half of it twice": f"{block} {words(20)} {block}",
        "one long word of copies": " ".join([words(8), "x".join(["abcdefgh"] * 40), words(10)]),
        "a long repeat in a longer text": f"{words(300)} {block} {words(300)} {block}",
        "empty": "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    kept = {r["doc_id"] for r in R.repetition(df).collect() if r["kept"]}
    assert kept == {"clean", "one line twice", "a long repeat in a longer text"}


def test_documents_that_share_a_passage_are_no_repetition(spark):
    rnd = random.Random(4)
    passage = " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(80))
    rows = [(i, f"{passage} {rnd.random()}") for i in range(50)]
    got = R.repetition(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert all(r["kept"] and r["longest_repeat"] == 0 for r in got)
