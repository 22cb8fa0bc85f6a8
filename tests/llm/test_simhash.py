from __future__ import annotations

import random

import xxhash

from rosterspark.llm.graph import connected_components
from rosterspark.llm.simhash import _signed, fingerprint, links, near_duplicates, one_of_each


def plain(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    """Brute force: ids by least id reachable over fingerprints of at most three differing bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_the_plain_one(rows):
    for r in rows[:20]:
        assert fingerprint(r[1]) & (1 << 64) - 1 == plain(r[1])


def test_near_duplicates_against_brute_force(docs, rows):
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = [plain(r[1]) for r in rows]
    group = components(prints)
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(g))) for r, p, g in zip(rows, prints, group))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == want


def test_links_lose_no_close_pair(spark):
    rnd = random.Random(5)
    prints = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        prints.append(x)
        for d in (0, 1, 2, 3, 3, 3, 4):
            y = x
            for b in rnd.sample(range(64), d):
                y ^= 1 << b
            prints.append(y)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(_signed(p),) for p in prints], "fp long")
    ties = links(df)
    for r in ties.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
    labels = {r["node"] & (1 << 64) - 1: r["label"] for r in connected_components(ties).collect()}
    group = components(prints)
    for i in range(len(prints)):
        for j in range(i):
            same = labels.get(prints[i], _signed(prints[i])) == labels.get(prints[j], _signed(prints[j]))
            assert same == (group[i] == group[j])


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (200, 201), (None, 5)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_and_empty(docs, empty):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    assert 0 in ids and 1 not in ids and 9 not in ids
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_near_copies_beyond_three_bits_go_and_others_stay(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(12)]
    rows, near = [], set()
    for i, b in enumerate(base):
        rows.append((len(rows), " ".join(b)))
        for at in (20, 90, 160):  # a run of new words: about 0.93 of the shingles stay
            c = [*b[:at], *(rnd.choice(words) for _ in range(4)), *b[at + 4 :]]
            near.add(len(rows))
            rows.append((len(rows), " ".join(c)))
        half = [*b[:100], *(rnd.choice(words) for _ in range(100))]
        rows.append((len(rows), " ".join(half)))
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(len(rows))) - near


def test_near_copies_without_their_original_are_as_by_all_pairs(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(words) for _ in range(600)]
    rows = []
    for i in range(150):
        c = list(base)
        for at in rnd.sample(range(600), rnd.randint(7, 9)):
            c[at] = rnd.choice(words)
        rows.append((i, " ".join(c)))
    for i in range(150, 300):  # short texts with one common line
        rows.append((i, " ".join([*(rnd.choice(words) for _ in range(15)), "this line is in all of the short texts here"])))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    prints = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 3 or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {find(i) for i in range(len(rows))}


def groups(texts):
    """Brute force: rows by least row reachable over fingerprints of at most three differing bits and over texts that
    resemble by 0.8 or more; and the pairs of different texts that do."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [fingerprint(t) & (1 << 64) - 1 for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, common = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] = common.get((own[b], own[a]), 0) + 1
    alike = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    close = [(j, i) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    for i, j in [*alike, *close]:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], [(i, j) for i, j in alike if sets[i] != sets[j]]


def test_recall_on_real_rows(spark):
    """Of all pairs that resemble by 0.8 or more, at most one in ten stays; and what stays is as by all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rnd = random.Random(17)
    for i, text in rnd.sample([r for r in rows if r[1] and 80 < len(r[1].split()) < 2000], 60):
        for _ in range(2):  # near copies, for the table itself has few
            words = text.split()
            for at in rnd.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = f"edit{rnd.randint(0, 999)}"
            rows.append((100_000 + len(rows), " ".join(words)))
    rows.sort()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    group, alike = groups([t for _, t in rows])
    kept = {r["doc_id"] for r in one_of_each(docs).select("doc_id").collect()}
    assert len(alike) > 100
    missed = sum(rows[i][0] in kept and rows[j][0] in kept for i, j in alike)
    assert missed <= 0.1 * len(alike)
    want = {rows[g][0] for g in group}
    assert len(kept ^ want) <= 0.01 * len(want)


def test_rows_with_one_id_and_different_texts_stay(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(120))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, "p"), (1, b, "q"), (2, b, "r"), (2, c, "s"), (3, c, "t"), (3, c, "t"), (4, d, "u"), (5, None, "v"), (6, "", "w"), (None, a, "x")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, other string"))
    got = sorted(((r["doc_id"], r["text"], r["other"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a, "p"), (1, b, "q"), (2, c, "s"), (4, d, "u"), (5, None, "v"), (None, a, "x")], key=str)
