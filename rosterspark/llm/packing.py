"""Packing of tokenised documents into sequences of bounded length, with lower bounds as certificates.

Documents are dealt to partitions; each packs its own by best-fit decreasing and compares the number of its sequences
with a lower bound from dual feasible functions.  Partitions that meet their bound are done, but for the sequence with
most room left.  Those that do not, and these open sequences, give up their documents, which are dealt anew to fewer
partitions and packed again, round by round, as long as sequences can still be saved.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collector_off, cut

CAPACITY = 4096
END = 1

_TOKENIZERS: dict[str, "Words"] = {}


#: Punctuation, letters (and whatever is no ASCII), punctuation; all of one word.
_PARTS = re.compile(rb"([!-/:-@\[-`{-~]*)([a-z\x80-\xff]*)([!-/:-@\[-`{-~]*)")


class Words:
    """Ids of white-space separated words by a tokenizer that never looks across ASCII white space (its pieces contain
    none and its normaliser composes nothing with it); remembers about ``remember`` words.

    A new word that is letters between punctuation is put together from the ids of these parts, which the tokenizer
    takes apart as well; the parts that are new are encoded in one go, and the marks for ends of words in the
    vocabulary tell them apart.  Other new words are encoded one by one."""

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.remember = remember

    def _one_by_one(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for word, made in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)):
                self.known[word] = np.array(made.ids, "<u4").tobytes()

    def _in_one_go(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                self._one_by_one(some)
                continue
            raw, begin = ids.tobytes(), 0
            for part, stop in zip(some, (4 * stops).tolist()):
                self.known[part] = raw[begin:stop]
                begin = stop

    def _learn(self, words: list[bytes]) -> None:
        known, whole, parts, put = self.known, [], set(), []
        for word in words:
            found = _PARTS.fullmatch(word)
            if found is None or found[1].endswith(b"'"):
                whole.append(word)
                continue
            before, core, after = found.groups()
            if core and not core.isascii():
                text = core.decode("utf-8")
                if not (text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)):
                    whole.append(word)
                    continue
            own = [x for x in (before, core, after) if x]
            parts.update(x for x in own if x not in known)
            if len(own) > 1:
                put.append((word, own))
        self._in_one_go(list(parts))
        self._one_by_one(whole)
        for word, own in put:
            known[word] = b"".join([known[x] for x in own])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers.  A-Z are put in lower case first, as the
        tokenizer would."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= 4_000_000):
                size += len(texts[end])
                end += 1
            if len(self.known) > self.remember:
                self.known.clear()
            with collector_off():
                split = [t.encode("utf-8", "replace").lower().split() for t in texts[start:end]]
                words = set()
                for found in split:
                    words.update(found)
                self._learn([w for w in words if w not in self.known])
            for found in split:
                yield b"".join(map(self.known.__getitem__, found))
            start = end


def _words(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.  A document's ids and ``end_id`` make one piece, or if
    they are more than ``capacity``, pieces of that length and a last, shorter one.  Null text: only ``end_id``."""
    kind = docs.schema[id_col].dataType
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("i", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", long), T.StructField("length", long), T.StructField("ids_crc32", long)]
    )
    last, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _words(path)
        for batch in batches:
            rows, number = [], []
            for at_row, ids in enumerate(tool.encode_batch([t or "" for t in batch.column("t").to_pylist()])):
                ids += last
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(at_row)
                    number.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = zip(*number) if number else ((), (), (), ())
            columns = [batch.column("i").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return plain.mapInArrow(apply, schema).withColumnRenamed("i", id_col)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place in it of each item (lengths 1 .. capacity), and the number of bins.

    Bins are kept by the room they have left; a bit for each room in use finds the least that is large enough."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, count = 0, 0
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fits = in_use >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = open_[room].pop()
            if not open_[room]:
                in_use ^= 1 << room
        else:
            room, own = capacity, count
            count += 1
        bins[item], places[item] = own, capacity - room
        if room > size:
            open_[room - size].append(own)
            in_use |= 1 << (room - size)
    return bins, places, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the greatest bound of a family of dual feasible functions.  The plain sum; items over
    capacity - t counted whole and those under t not at all; and rounding to multiples of 1 / k."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    total = int((sizes * counts).sum())
    best = -(-total // capacity)
    for t in np.unique(np.concatenate([sizes[2 * sizes <= capacity], capacity - sizes[2 * sizes > capacity]])):
        if t < 1:
            continue
        value = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 101):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _deal(items: DataFrame, parts: int, salt: int) -> DataFrame:
    """Pieces dealt evenly and the same way each time: by a hash of what they are."""
    return items.withColumn("part", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32", F.lit(salt)), F.lit(parts)))


def _pack(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing within each ``part``; ``bin``, ``offset``, and of the part: ``bins``, ``bound``, and whether
    the row's bin is the ``open`` one (most room left)."""
    fields = [f for f in items.schema.fields if f.name not in ("bin", "offset", "bins", "bound", "open")]
    schema = T.StructType(
        [*fields, *[T.StructField(n, T.LongType()) for n in ("bin", "offset", "bins", "bound")], T.StructField("open", T.BooleanType())]
    )
    names = [f.name for f in fields]

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        group["bin"], group["offset"], count = best_fit_decreasing(lengths, capacity)
        group["bins"], group["bound"] = count, lower_bound(lengths, capacity)
        filled = np.bincount(group["bin"], weights=lengths, minlength=count)
        group["open"] = group["bin"] == int(filled.argmin())
        return group

    return items.select(*names).groupBy("part").applyInPandas(apply, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, per_part: int = 16_384) -> DataFrame:
    """``items`` (key, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``, and the certificate of the
    partition that packed them: how many sequences it filled, and that it could not have done with fewer than ``bound``.

    ``per_part`` is how many pieces a partition packs on average, whatever the size of the input.  Partitions above their
    bound exchange pieces, and go on as long as a round saves a sequence."""
    total = items.count()
    parts = max(1, -(-total // per_part))
    todo, done, base = _deal(items, parts, 0), None, 0
    packed = cut(_pack(todo, capacity))
    for salt in itertools.count(1):
        loose = (F.col("bins") > F.col("bound")) | F.col("open")
        moving = packed.filter(loose)
        before = moving.select("part", "bin").distinct().count()
        row = moving.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
        if not row["n"] or before <= -(-row["tokens"] // capacity):
            break
        fewer = max(1, min(parts - 1, -(-row["n"] // per_part)))
        again = cut(_pack(_deal(moving.select(*items.columns), fewer, salt), capacity))
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        kept = packed.filter(~loose).withColumn("round", F.lit(base))
        done = kept if done is None else done.unionByName(kept)
        packed, parts, base = again, fewer, base + 1
    rest = packed.withColumn("round", F.lit(base))
    done = rest if done is None else done.unionByName(rest)
    numbered = F.shiftleft(F.col("round").cast("long"), 52) + F.shiftleft(F.col("part").cast("long"), 26) + F.col("bin")
    return done.select(*items.columns, numbered.alias("sequence_id"), "offset", F.col("bins").alias("n_sequences"), "bound")


def certificates(packed: DataFrame) -> DataFrame:
    """``part, n_sequences, bound`` for each partition that packed some of the pieces."""
    return packed.select(F.shiftright("sequence_id", 26).alias("part"), "n_sequences", "bound").distinct()


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, per_part: int = 16_384) -> DataFrame:
    """Tokenise ``docs`` and pack them: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the certificate of
    :func:`pack`.  Pieces of equal length go by their ids' checksum and their number.

    Each row of ``docs`` is packed, also repeated ones, those with null ids and null or empty texts (one token); other
    columns are ignored.  Only documents above ``capacity`` are cut.  An empty table gives an empty one."""
    found = cut(pieces(docs, path, id_col, text_col, capacity).withColumnRenamed(id_col, "key"))
    return pack(found, capacity, per_part).withColumnRenamed("key", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document of ``documents`` stands in the packed sequences; see :func:`pack_documents`."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
