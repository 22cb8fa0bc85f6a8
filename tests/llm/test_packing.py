from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rosterspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def tool():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(out, capacity):
    """Places are gapless, nothing overfull."""
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(docs, rows, empty):
    out = packing.pack_documents(docs, PATH).collect()
    check(out, 4096)
    want = []
    for r in rows:
        ids = [*tool().encode(r[1] or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((str(r[0]), n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_words_are_as_the_library_has_them():
    rnd = random.Random(2)
    alphabet = "abcXYZ éÉßİıK'\"!?.,&$%0123<|>_`~ñ \x1f\x85日本ΣςАя-  \n\t"
    texts = ["it's 'so don't they'll <|endoftext|> a'b", "", "İstanbul ΑΣ ﬁx ½"] + ["".join(rnd.choices(alphabet, k=80)) for _ in range(500)]
    words, library = packing.Words(PATH, remember=100), tool()
    for text, ids in zip(texts, words.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bounds_and_bins():
    rnd = random.Random(4)
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))])
        bins, places, count = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and len(set(bins.tolist())) == count
        assert -(-sizes.sum() // 100) <= packing.lower_bound(sizes, 100) <= count
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.array([], np.int64), 100) == 0


def test_exchange_saves_sequences(spark):
    rnd = random.Random(6)
    items = spark.createDataFrame([(i, 0, 0, rnd.randint(1, 2100), i) for i in range(1500)], "key long, piece int, start long, length long, ids_crc32 long")
    alone = packing._pack(packing._deal(items, 25, 0), 4096).select("part", "bin").distinct().count()
    packed = packing.pack(items, 4096, per_part=60).cache()
    out = packed.collect()
    assert len(out) == 1500
    total = sum(r["length"] for r in out)
    assert -(-total // 4096) <= check(out, 4096) <= alone
    told = packing.certificates(packed).collect()
    assert all(r["n_sequences"] >= r["bound"] > 0 for r in told)
    # a partition above its bound is one that no further round could mend: there is a last one only
    assert sum(r["n_sequences"] > r["bound"] for r in told) <= sum(r["part"] >> 26 == max(x["part"] >> 26 for x in told) for r in told)


def test_a_single_partition_is_certified(spark):
    items = spark.createDataFrame([(i, 0, 0, 1365, i) for i in range(90)], "key long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(items, 4096).collect()
    assert check(packed, 4096) == 30 and {(r["n_sequences"], r["bound"]) for r in packed} == {(30, 30)}
