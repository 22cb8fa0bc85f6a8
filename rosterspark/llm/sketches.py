"""Bottom-k sketches of word shingles: a text's k least distinct shingle hashes.

The sketch of two parts together is the k least of both sketches, so sketches merge in any order.  Two sketches
estimate resemblance and containment of their shingle sets, one the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, table

K = 128
WORDS = 5
#: Hashes are cut to 48 bits: eight characters of base64 each.
BITS = 48


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The ``k`` least distinct hashes of shingles of ``words`` words (A-Z lower-cased), ascending.  A text of fewer
    words is one shingle, one without words has none."""
    import xxhash

    tokens = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=7), shingles), np.uint64) >> np.uint64(64 - BITS)
    return least(hashes, k)


def least(hashes: np.ndarray, k: int) -> np.ndarray:
    size = 4 * k
    if len(hashes) > 2 * size:  # most rows repeat nothing among their least, so a part of them mostly suffices
        found = np.unique(np.partition(hashes, size)[:size])
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of all shingles of both, 0 to 1; 1 for two empty sketches."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of the first's shingles that the second has, 0 to 1; 1 if the first has none."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def with_sketch(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` with the sketch of ``text_col`` as text in ``into``; null text counts as empty (an empty sketch)."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(sketch(t, k, words)), na_action=None)

    return docs.withColumn(into, of(F.coalesce(F.col(text_col), F.lit(""))))


def merge_sketches(parts: DataFrame, by: list[str], sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each group of rows: the hashes are taken apart and the ``k`` least of a group kept, first within
    each task and then over all (windows over distinct hashes, so no group is collected)."""
    from pyspark.sql import Window

    cells = parts.select(*by, F.explode(F.expr(f"transform(sequence(0, length({sketch_col}) div 8), i -> substring({sketch_col}, 8 * i + 1, 8))")).alias("cell"))
    cells = cells.filter("cell != ''").withColumn("cell", F.hex(F.unbase64("cell"))).distinct()
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(32)))
    first = Window.partitionBy(*by, "salt").orderBy("cell")
    last = Window.partitionBy(*by).orderBy("cell")
    best = salted.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    best = best.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: F.base64(F.unhex(c))), "")
    return best.groupBy(*by).agg(joined.alias(sketch_col))


#: Ranges for each partition of :func:`edited_pairs`: several, so that partitions get about as many.
RANGES = 4


def _heads(keyed: DataFrame, rows_each: int, most: int) -> list[tuple]:
    """The least key of each range of about ``rows_each`` rows: whether there is an id, the id, the text's hash.  Only
    these columns are dealt; ``most`` bounds what reaches the driver."""
    parts = int(min(most, max(1, -(-keyed.count() // rows_each))))
    ranged = keyed.select("some", "i", "h").repartitionByRange(parts, "some", "i", "h")
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("some", "i", "h")).alias("m"))
    return sorted(((r["m"]["some"], r["m"]["i"] if r["m"]["some"] else 0, r["m"]["h"]) for r in found.collect()))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 2048, most: int = 1_000_000) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last half is replaced by the first as many
    code points of the next document (by ascending id, of any type that has an order; null ids come first; of equal
    ids the lesser XXH64 of the text first; after the last comes the first; a single document follows itself).  Also
    the estimated number of distinct shingles, and how much of the fingerprint's shingles the edited text has.  Null
    texts count as empty; texts of any length are read whole; repeated rows follow each other; an empty table gives an
    empty one; other columns, whatever their names, are ignored.

    Documents are dealt out by ranges of id and hash, so one id may have very many rows, and each range also gets a
    copy of the first document of the next one: as many rows more as there are ranges.  Within a range, rows stream by
    in order."""
    kind = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keyed = plain.select(F.col("i").isNotNull().alias("some"), "i", F.xxhash64("t").alias("h"), "t")
    heads = _heads(keyed, -(-rows_each // RANGES), most)
    place = T.StructType([*keyed.schema.fields, T.StructField("b", T.IntegerType()), T.StructField("guest", T.BooleanType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, ranges, guest = [], [], []
            for n, (i, h) in enumerate(zip(batch.column("i").to_pylist(), batch.column("h").to_pylist())):
                key = (i is not None, 0 if i is None else i, h)
                b = bisect_right(heads, key) - 1
                rows.append(n)
                ranges.append(b)
                guest.append(False)
                if heads[b] == key:
                    rows.append(n)
                    ranges.append((b - 1) % len(heads))
                    guest.append(True)
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ranges, pa.int32()), pa.array(guest)], place.names)

    parts = max(1, len(heads) // RANGES)
    dealt = keyed.mapInArrow(deal, place).repartition(parts, "b").sortWithinPartitions("b", "guest", "some", "i", "h", "t").select("i", "t", "guest")
    schema = T.StructType(
        [
            T.StructField("i", kind),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
            T.StructField("n_shingles", T.DoubleType()),
            T.StructField("held_by_edited", T.DoubleType()),
        ]
    )

    target = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last own row, until its next is known
        for batch in slices(batches):
            rows = []
            for i, t, guest in zip(*(batch.column(c).to_pylist() for c in ("i", "t", "guest"))):
                if held is None and guest:
                    continue  # further documents that share the id of the first
                mine = sketch(t)
                if held is not None:
                    key, text, old = held
                    half = len(text) // 2
                    edited = text[: len(text) - half] + t[:half]
                    new = sketch(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, len(text), digest, as_text(old), as_text(new), resemblance(old, new), resemblance(old, mine), distinct(old), containment(old, new)))
                held = None if guest else (i, t, mine)
            columns = zip(*rows) if rows else [()] * len(schema.names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema.names)

    return dealt.mapInArrow(apply, schema).withColumnRenamed("i", id_col)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts; see :func:`edited_pairs`."""
    return edited_pairs(table(spark, sf_dir, "documents"))
