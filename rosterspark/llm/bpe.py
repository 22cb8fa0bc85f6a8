"""Byte-level BPE on padded numpy matrices.

A text is split into pieces by the tokenizer's pattern.  Pieces not seen lately go, in buckets of like length, into
matrices of one row per piece, padded on the right.  In each round every row merges its leftmost pair of least rank;
a table hashed by pair gives the ranks, shifting left closes the gap, and rows without a pair left are taken out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collector_off

NONE = np.int32(0x7FFFFFFF)
#: Pieces above this many bytes are merged with a heap: a row of a matrix costs the square of its length.
LONG = 192


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            taken, first = np.unique(slots[free], return_index=True)
            now = free[first]
            self.keys[taken], self.ranks[taken] = keys[now], ranks[now]
            done = np.zeros(len(keys), bool)
            done[now] = True
            todo = todo[~done[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they make no token or one of them is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        flat = np.where((left < 0) | (right < 0), np.int64(-2), keys).ravel()
        slots, out = self._slot(flat), np.full(flat.shape, NONE, np.int32)
        todo = np.flatnonzero(flat >= 0)
        while len(todo):
            at = slots[todo]
            seen = self.keys[at]
            hit = seen == flat[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (seen >= 0)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks of byte strings, read from a file of ``base64 rank`` lines."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get = self.ranks.get
        keys, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(made, np.int32))
        self.pair_of = dict(zip(keys, made))


def merge_matrix(rows: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows``: token ids, padded with -1 on the right.  Yields rows in which nothing merges any more, some at a time:
    their places in the input and the (still padded) ids."""
    which, ranks = np.arange(len(rows)), pairs(rows[:, :-1], rows[:, 1:])
    while len(rows):
        if rows.shape[1] < 2:
            yield which, rows
            return
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(rows)), at]
        still = least != NONE
        if not still.all():
            yield which[~still], rows[~still]
            rows, which, ranks, at, least = rows[still], which[still], ranks[still], at[still], least[still]
            if not len(rows):
                return
        n, each, width = len(rows), np.arange(len(rows)), rows.shape[1] - 1
        # the merged pair's right token and the pair itself go; what is on their right moves up
        rows[each, at] = least
        keep = np.ones(rows.shape, bool)
        keep[each, at + 1] = False
        rows = rows[keep].reshape(n, width)
        keep = np.ones(ranks.shape, bool)
        keep[each, at] = False
        ranks = ranks[keep].reshape(n, width - 1)
        right, left = np.flatnonzero(at < width - 1), np.flatnonzero(at > 0)
        ranks[right, at[right]] = pairs(least[right], rows[right, at[right] + 1])
        ranks[left, at[left] - 1] = pairs(rows[left, at[left] - 1], least[left])


def merge_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same merges for one long piece with a heap of pairs over a linked list."""
    ids = vocabulary.single[np.frombuffer(piece, np.uint8)].tolist()
    pair_of, n = vocabulary.pair_of, len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair_of.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := pair_of.get(ids[x] << 32 | ids[y])) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [t for t, lives in zip(ids, alive) if lives]


class Encoder:
    """Encodes texts; remembers the words it has met, about ``remember`` of them."""

    def __init__(self, path: str, pattern: str, remember: int = 700_000):
        import regex

        self.vocabulary, self.split = Vocabulary(path), regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(len(self.vocabulary.tokens))]
        self.words: dict[str, str | None] = {}
        self.firsts: dict[str, str | None] = {}
        self.meaning = dict(zip(self.decimal, self.vocabulary.tokens))
        self.remember = remember

    def _merged(self, pieces: list[str]) -> dict[str, str]:
        """The ids of each piece, in decimal."""
        out: dict[str, str] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ranks = self.vocabulary.ranks
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = ranks.get(b)
            if whole is not None:
                out[pieces[i]] = self.decimal[whole]
            elif len(b) > LONG:
                out[pieces[i]] = ",".join(map(str, merge_long(b, self.vocabulary)))
            else:
                buckets.setdefault(len(b) if len(b) < 24 else len(b) + 15 & ~15, []).append(i)
        number = self.decimal.__getitem__
        for width, members in buckets.items():
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                rows = np.full((len(part), width), -1, np.int32)
                lengths = np.fromiter((len(raw[i]) for i in part), np.int64, len(part))
                rows[np.arange(width)[None, :] < lengths[:, None]] = self.vocabulary.single[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for which, ids in merge_matrix(rows, self.vocabulary.pairs):
                    real = ids >= 0
                    flat, ends = list(map(number, ids[real].tolist())), real.sum(axis=1).cumsum().tolist()
                    begin = 0
                    for i, end in zip(which.tolist(), ends):
                        out[pieces[part[i]]] = ",".join(flat[begin:end])
                        begin = end
        return out

    def _learn(self, words: list[str], gap: str, known: dict[str, str | None]) -> None:
        """Ids of ``gap + word``; None for words that may not be split off (empty, or white space at an end)."""
        whole, found = [], []
        for word in words:
            if word.isalpha():  # letters only: one match of the pattern
                whole.append(word)
            elif not word or word[0].isspace() or word[-1].isspace():
                known[word] = None
            else:
                found.append((word, self.split(gap + word)))
        ids = self._merged(list({gap + w for w in whole}.union(*(pieces for _, pieces in found))))
        for word in whole:
            known[word] = ids[gap + word]
        for word, pieces in found:
            known[word] = ",".join(map(ids.__getitem__, pieces))

    def encode_batch(self, texts: list[str]) -> Iterator[str]:
        """Each text's ids, in decimal, joined by commas (no ids: empty).

        The pattern has no match that goes on over a space between two characters that are no white space, and none
        looks back; so a text may be cut before each such space, and whole words are remembered.  A text with other
        white space around a space is split by the pattern as a whole."""
        start = 0
        while start < len(texts):  # as many texts at once as make up some megabytes
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= 4_000_000):
                size += len(texts[end])
                end += 1
            for memory in (self.words, self.firsts):
                if len(memory) > self.remember:
                    memory.clear()
            with collector_off():
                cut = [t.split(" ") for t in texts[start:end]]
                rest = set()
                for words in cut:
                    rest.update(words[1:])
                self._learn([w for w in {words[0] for words in cut} if w not in self.firsts], "", self.firsts)
                self._learn([w for w in rest if w not in self.words], " ", self.words)
            for words, text in zip(cut, texts[start:end]):
                ids = list(map(self.words.__getitem__, words[1:]))
                ids.insert(0, self.firsts[words[0]])
                if None in ids:
                    pieces = self.split(text)
                    ids = map(self._merged(list(set(pieces))).__getitem__, pieces)
                yield ",".join(ids)
            start = end

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.meaning.__getitem__, ids.split(","))) if ids else b""


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker: the vocabulary file is installed on every machine."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text_col`` (null text: no ids) in ``into``."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = _encoder(path, pattern)
        for batch in batches:
            yield pd.Series([[int(x) for x in ids.split(",")] if ids else [] for ids in tool.encode_batch(batch.fillna("").tolist())], dtype=object)

    return docs.withColumn(into, ids_of(F.col(text_col)))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "bytes") -> DataFrame:
    """``docs`` with the bytes that the ids stand for (null: none)."""

    @F.pandas_udf(T.BinaryType())
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = _encoder(path, pattern)
        for batch in batches:
            yield pd.Series([b"" if ids is None else tool.decode(",".join(map(str, ids))) for ids in batch], dtype=object)

    return docs.withColumn(into, bytes_of(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, digest of the ids and digest of the bytes decoded from them.

    Null texts count as empty (no tokens, digests of nothing); repeated rows, null ids and further columns do no harm."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("i", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for ids in tool.encode_batch([t or "" for t in batch.column("t").to_pylist()]):
                counts.append(ids.count(",") + 1 if ids else 0)
                first.append(hashlib.sha256(ids.encode()).hexdigest())
                second.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            columns = [batch.column("i"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return plain.mapInArrow(apply, schema).withColumnRenamed("i", id_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again.  Nulls count as empty, texts of any length are
    encoded whole, repeated rows give repeated rows, an empty table an empty one; other columns are ignored."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
