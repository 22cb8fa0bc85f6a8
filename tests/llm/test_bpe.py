from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken

from rosterspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip_is_as_the_library_does_it(docs, rows, empty):
    ranks = bpe.Vocabulary(PATH).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_odd_texts():
    tool = bpe.Encoder(PATH, public_tokenizers.PATTERN, remember=50)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.vocabulary.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a", "a  b", " \n x", "x \n", "a" * 5000, "ab" * 700, "<|endoftext|>", "it's we'll 'S", "é́ x"]
    texts += ["".join(rnd.choices("abcdeé gh'1\n\t .日", k=rnd.randint(1, 400))) for _ in range(300)]
    for text, ids in zip(texts, tool.encode_batch(texts)):
        assert ids == ",".join(map(str, library.encode_ordinary(text)))
        assert tool.decode(ids) == text.encode()


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["bytes"]) for r in out] == [b"hello world", b"", b""]
