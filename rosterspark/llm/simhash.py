"""Near-duplicate detection on 64-bit SimHash fingerprints by meet-in-the-middle ball hashing.

Two fingerprints x and y at distance d <= 3 share a point of the ball of radius 1 around the one and of the ball of
radius 2 around the other.  So every fingerprint emits the points around it, points are the shuffle key, and whoever
meets at a point is compared.  What keeps this linear:

* Only different fingerprints take part; copies of a text are one row with its least document id.
* Parity: an odd distance means that one fingerprint has an even and the other an odd number of set bits.  Even ones
  emit only the inner ball, odd ones also pairs of flips.
* Of three differing bits two lie in the same half of the word, so only pairs of flips within one half are needed.
* Three differing bits leave one half with at most one of them.  A fingerprint can have a partner only where a half
  meets another fingerprint's half in the same way (ball of radius 1 over 32 bits, again by parity).  This is counted
  first, without pairs, and settles most fingerprints; it tells also in which half flips are worth emitting.
* At a point, whoever is within radius 1 of it is within 3 of everyone else there.  So all are tied to the least of
  these inner members: a star, never all pairs.  Each tie is verified by its distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices
from .graph import connected_components

RADIUS = 3
SEED = 42
_BYTES = np.arange(256, dtype=np.uint8)[:, None] >> np.arange(7, -1, -1, dtype=np.uint8) & 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text as a signed 64-bit number; 0 when there is no word."""
    import xxhash

    tokens = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    # how often each byte value stands in each of the eight bytes, then how often each bit is set
    flat = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) > 512:
        counts = np.concatenate([np.bincount(flat[:, i], minlength=256) @ _BYTES for i in range(8)])
    else:
        counts = np.unpackbits(flat, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col, fp``: one row per document; null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((fingerprint(t, words) for t in batch.column("t").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found)], ["i", "fp"])

    schema = T.StructType([T.StructField("i", kind), T.StructField("fp", T.LongType())])
    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return plain.mapInArrow(apply, schema).withColumnRenamed("i", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _array(masks: list[int]) -> F.Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def active_halves(prints: DataFrame) -> DataFrame:
    """``fp, low, high``: fingerprints whose upper / lower 32 bits come within one bit of another's, and so must look
    for partners by flips in the other half; others have none within three bits."""
    odd = (F.bit_count(F.col("part")) % 2) == 1
    keys = F.when(odd, F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1), i)))).otherwise(F.array(F.lit(0)))
    halves = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).cast("long").alias("part")), F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("part")))).alias("h"))
    halves = halves.select("fp", "h.half", F.col("h.part").alias("part"))
    points = halves.select("fp", "half", F.explode(keys).alias("flip"), "part").select("fp", "half", F.col("part").bitwiseXOR(F.col("flip").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("point"))
    # A point counts if two different fingerprints are there; the extremes tell that without listing them.
    shared = points.groupBy("half", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b").select("half", "point")
    met = points.join(shared, ["half", "point"], "left_semi")
    return met.groupBy("fp").agg(F.max(F.col("half") == 1).alias("high"), F.max(F.col("half") == 0).alias("low"))


def links(prints: DataFrame) -> DataFrame:
    """``prints`` has one row per different fingerprint (long ``fp``).  Returns edges ``a, b`` between fingerprints of
    at most three differing bits: every such pair is connected through them, and no other is."""
    active = cut(active_halves(prints))
    low = [1 << i for i in range(32)]
    high = [1 << i for i in range(32, 64)]
    pairs = lambda bits: [x | y for n, x in enumerate(bits) for y in bits[:n]]
    # `low`: the upper half has met someone, so the lower half may hold two or three of the differing bits
    inner = active.select("fp", F.explode(_array([0, *low, *high])).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp", F.lit(True).alias("inner")
    )
    odd = active.filter(F.bit_count("fp") % 2 == 1)
    outer = None
    for side, bits in (("low", low), ("high", high)):
        some = odd.filter(side).select("fp", F.explode(_array(pairs(bits))).alias("flip"))
        some = some.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp", F.lit(False).alias("inner"))
        outer = some if outer is None else outer.unionByName(some)
    points = inner.unionByName(outer)
    # At most 1 + 64 + 2016 different fingerprints are within two bits of a point, so the list is bounded.
    met = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("all"))
    ties = met.filter("b is not null and size(all) > 1").select(F.explode("all").alias("a"), "b").filter("a != b")
    return ties.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Null texts count as empty; texts without words have fingerprint zero and link like others.  Repeated rows give
    repeated rows.  A row with a null id keeps its place in a component but never names it (a component of only such
    rows is null).  An empty table gives an empty one; other columns are ignored."""
    prints = cut(with_fingerprint(docs, id_col, text_col, words))
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    labels = cut(connected_components(links(classes.select("fp"))))
    joined = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = cut(joined.join(least, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Near copies for deduplication: five-word shingles, one permutation cut into BINS, bands of ROWS bins.
WORDS, BINS, ROWS = 5, 128, 4
#: Resemblance from which two texts are near copies, and the estimate from which a pair is compared by its whole texts
#: (three deviations of 0.035 at 128 bins lower).
ALIKE, MAYBE = 0.8, 0.695
_EMPTY = -1


def signature(text: str | None, words: int = WORDS, bins: int = BINS) -> np.ndarray:
    """The least hash of the shingles that fall into each bin (31 bits; -1 where none does)."""
    return _signature(text, words, bins)[0]


def _signature(text: str | None, words: int = WORDS, bins: int = BINS) -> tuple[np.ndarray, int]:
    """The signature and the number of shingles, repeated ones counted."""
    import xxhash

    tokens = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    out = np.full(bins, _EMPTY, np.int32)
    if not tokens:
        return out, 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) > words else [b" ".join(tokens)]
    hashes = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64))[::-1]  # so that the least stays
    out[(hashes & np.uint64(bins - 1)).astype(np.int64)] = (hashes >> np.uint64(33)).astype(np.int32)
    return out, len(hashes)


def _band_keys(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures one after another: hashes of their bands, and which bands are filled."""
    mix = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = np.arange(BINS // ROWS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    bands = flat.reshape(-1, BINS // ROWS, ROWS)
    mixed = ((bands.astype(np.uint64) + np.uint64(7)) * mix).sum(axis=2) + own
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), (bands != _EMPTY).any(axis=2)


def _with_signature(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``i, fp, sig, keys, size`` of each row: id, SimHash fingerprint, 15 bits of each bin of the signature (two bins
    that differ look equal once in 30,000 times, which only has a pair more compared), hashes of its bands that aren't
    empty, from all bits, and number of shingles."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("fp", T.LongType()), T.StructField("sig", T.ArrayType(T.ShortType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("t").to_pylist()
            prints = np.fromiter((fingerprint(t, words) for t in texts), np.int64, len(texts))
            signed = [_signature(t) for t in texts]
            flat = np.concatenate([x for x, _ in signed]) if texts else np.empty(0, np.int32)
            short = np.where(flat == _EMPTY, _EMPTY, flat & 0x7FFF).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BINS, dtype=np.int32)), pa.array(short))
            hashed, filled = _band_keys(flat)
            ends = np.concatenate([[0], filled.sum(axis=1).cumsum()]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[filled]))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(prints), lists, keys, pa.array([n for _, n in signed], pa.int64())], schema.names)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(apply, schema)


def _meetings(rows: DataFrame) -> DataFrame:
    """``key, c, degree``: the bands by which texts meet others.

    Texts with an equal band of ROWS bins meet (at a resemblance of 0.8 one of the 32 bands is equal for all but one
    in ten million pairs).  A text of ``size`` shingles differs from one at 0.8 or more in at most a quarter of as
    many, and each spoils one band at most.  So of its bands, those that fewest texts have first, the first equal one
    is within the first ``size / 4 + 1``, on both sides, and the others need not be emitted: this keeps a line that is
    in very many short texts from tying them all."""
    met = rows.select("c", "size", F.size("keys").alias("filled"), F.explode("keys").alias("key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = met.join(shared, "key").groupBy("c").agg(
        F.first("size").alias("size"), F.first("filled").alias("filled"), F.sum(F.col("n") - 1).alias("degree"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held")
    )
    # bands that no other text has are the rarest and come first
    first = F.floor(F.col("size") / 4) + 1 - (F.col("filled") - F.size("held"))
    some = live.withColumn("first", first.cast("int")).filter("first > 0")
    return some.select("c", "degree", F.explode(F.slice("held", F.lit(1), F.col("first"))).alias("h")).select("h.key", "c", "degree")


def near_copy_pairs(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs ``i_x, fp_x, i_y, fp_y`` of an estimated resemblance of at least MAYBE, where of the texts that meet each is
    compared with one: the one that meets most others over all bands, as the original among its edited copies does.
    So pairs are at most as many as bands.  What these leave open is for :func:`open_pairs`."""
    centres = live.groupBy("key").agg(F.max(F.struct("degree", "c")).alias("top")).select("key", F.col("top.c").alias("centre"))
    pairs = live.join(centres, "key").filter("c != centre").select(F.greatest("c", "centre").alias("x"), F.least("c", "centre").alias("y")).distinct()
    side = lambda n: rows.select(F.col("c").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("i", "fp", "sig")])
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    bins = F.zip_with("sig_x", "sig_y", lambda p, q: F.when((p == _EMPTY) & (q == _EMPTY), -1).when(p == q, 1).otherwise(0))
    used = both.select("i_x", "fp_x", "i_y", "fp_y", bins.alias("bins"))
    equal, all_ = F.size(F.filter("bins", lambda v: v == 1)), F.size(F.filter("bins", lambda v: v >= 0))
    return used.filter((equal >= MAYBE * all_) & (F.col("fp_x") != F.col("fp_y"))).drop("bins")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one ``cell`` after another, from batches in order of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for at, to in zip(starts[:-1], starts[1:]):
            if held and held[0].column("cell")[0].as_py() != cell[at]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The numpy array of each row of a list column."""
    part = column.combine_chunks()
    ends, flat = part.offsets.to_numpy(), part.values.to_numpy(zero_copy_only=False)
    return [flat[at:to] for at, to in zip(ends[:-1], ends[1:])]


def open_pairs(rows: DataFrame, live: DataFrame, labels: DataFrame, block: int = 256) -> DataFrame:
    """``cell, i_x, fp_x, i_y, fp_y``: all pairs that meet, aren't of one component yet and have an estimated
    resemblance of at least MAYBE, each once.

    Where all who meet are of one component nothing is open.  Elsewhere everyone outside the largest component there
    is compared with everyone, in cells of two blocks of about ``block`` texts, so no task holds a whole bucket and
    a pair is no row unless it passes."""
    named = rows.join(labels, rows["fp"] == labels["node"], "left").withColumn("label", F.coalesce("label", "fp"))
    own = live.groupBy("c").agg(F.collect_list("key").alias("own"))
    named = cut(named.join(own, "c").select("c", "i", "fp", "sig", "own", "label"))
    there = live.select("key", "c").join(named.select("c", "label"), "c")
    kinds = there.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    kinds = kinds.select("key", F.col("top.label").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    # blocks of the others are numbered first, then those of the largest component
    placed = there.join(kinds, "key").withColumn("of", F.when(F.col("label") == F.col("top"), F.col("few") + F.pmod(F.xxhash64("c", "key"), F.col("many"))).otherwise(F.pmod(F.xxhash64("c", "key"), F.col("few"))).cast("int"))
    last = F.when(F.col("of") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    cells = placed.select("key", "c", "of", F.explode(F.sequence(F.lit(0), last)).alias("with"))
    cells = cells.select("key", "c", "of", F.least("of", "with").alias("p"), F.greatest("of", "with").alias("q"))
    dealt = cells.join(named, "c").withColumn("cell", F.xxhash64("key", "p", "q"))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell").select("cell", "key", "p", "q", "of", "i", "fp", "label", "sig", "own")
    kind = rows.schema["i"].dataType
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("i_x", kind), T.StructField("fp_x", T.LongType()), T.StructField("i_y", kind), T.StructField("fp_y", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_cell(batches):
            key, of = group.column("key").to_numpy(), group.column("of").to_numpy()
            p, q = group.column("p").to_numpy(), group.column("q").to_numpy()
            if (key != key[0]).any() or (p != p[0]).any() or (q != q[0]).any():
                raise RuntimeError("two cells with one hash")
            label, fp = group.column("label").to_numpy(), group.column("fp").to_numpy()
            xs, ys = np.flatnonzero(of == p), np.flatnonzero(of == q)
            if not len(xs) or not len(ys):
                continue
            sig = np.stack(_lists(group.column("sig")))
            own = _lists(group.column("own"))
            found_x, found_y = [], []
            for x in xs:
                other = ys[(label[ys] != label[x]) & ((ys > x) | (p[0] != q[0]))]
                equal = ((sig[other] == sig[x]) & (sig[x] != _EMPTY)).sum(axis=1)
                filled = ((sig[other] != _EMPTY) | (sig[x] != _EMPTY)).sum(axis=1)
                other = other[equal >= MAYBE * filled]
                # a pair that meets by several bands is told at the least of these
                other = np.array([y for y in other if np.intersect1d(own[x], own[y]).min() == key[0]], np.int64)
                if len(other):
                    found_x.append(np.full(len(other), x))
                    found_y.append(other)
            if found_x:
                x, y = np.concatenate(found_x), np.concatenate(found_y)
                ids = group.column("i").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), group.column("cell")[0].as_py(), np.int64)), ids.take(pa.array(x)), pa.array(fp[x]), ids.take(pa.array(y)), pa.array(fp[y])], schema.names)

    return dealt.mapInArrow(apply, schema)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, small: int) -> DataFrame:
    """``i, s``: the shingles of the texts with these row names, which go to all tasks if they are at most ``small``."""
    wanted = F.broadcast(ids) if ids.count() <= small else ids
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(wanted, "i").dropDuplicates(["i"])  # equal texts
    schema = T.StructType([T.StructField("i", docs.schema[id_col].dataType), T.StructField("s", T.ArrayType(T.LongType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([_shingles(t) for t in batch.column("t").to_pylist()], pa.list_(pa.int64()))], schema.names)

    return cut(texts.mapInArrow(apply, schema))


def _settled(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` with a ``cell`` those that resemble by ALIKE or more, as edges.  A text goes to each cell once."""
    sides = [pairs.select("cell", F.col(f"i_{n}").alias("i"), F.col(f"fp_{n}").alias("fp")) for n in ("x", "y")]
    texts = sides[0].unionByName(sides[1]).distinct().join(sets, "i").select("cell", "fp", "s", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    asked = pairs.select("cell", F.lit(None).cast("long").alias("fp"), F.lit(None).cast("array<long>").alias("s"), F.col("fp_x").alias("a"), F.col("fp_y").alias("b"))
    dealt = texts.unionByName(asked).repartition("cell").sortWithinPartitions("cell")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_cell(batches):
            is_text = pa.compute.is_valid(group.column("fp"))
            texts, asked = group.filter(is_text), group.filter(pa.compute.invert(is_text))
            of = dict(zip(texts.column("fp").to_pylist(), _lists(texts.column("s"))))
            found = [(a, b) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()) if _alike(of[a], of[b])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(apply, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ordered sets resemble by ALIKE or more."""
    if not len(x) or not len(y) or min(len(x), len(y)) < ALIKE * max(len(x), len(y)):
        return False
    n = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return n >= ALIKE * (len(x) + len(y) - n)


def near_copy_labels(docs: DataFrame, ties: DataFrame, id_col: str, text_col: str, words: int = 3, small: int = 200_000) -> DataFrame:
    """``node, label`` of fingerprints: components by ``ties`` and by texts that resemble by ALIKE or more over
    five-word shingles.

    Pairs found by signatures are settled by the shingles of the whole texts: first those with a centre, which makes
    most copies one component, then all that are still open between different components.  A text is named by its id
    and hash, so that rows with one id and different texts stay apart."""
    docs = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")).alias("i"), F.col(text_col).alias("t"))
    id_col, text_col = "i", "t"
    signed = _with_signature(docs, id_col, text_col, words).groupBy("fp", "sig").agg(F.min("i").alias("i"), F.first("keys").alias("keys"), F.max("size").alias("size"))
    rows = cut(signed.select(F.xxhash64("fp", "sig").alias("c"), "i", "fp", "sig", "keys", "size"))
    live = cut(_meetings(rows))
    ids = lambda pairs: cut(pairs.select(F.col("i_x").alias("i")).unionByName(pairs.select(F.col("i_y").alias("i"))).distinct())
    pairs = cut(near_copy_pairs(rows, live))
    sets = _sets(docs, ids(pairs), id_col, text_col, small)
    side = lambda n: sets.select(F.col("i").alias(f"i_{n}"), F.col("s").alias(f"s_{n}"))
    both = pairs.join(side("x"), "i_x").join(side("y"), "i_y")
    shared = F.size(F.array_intersect("s_x", "s_y"))
    alike = both.select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b"), shared.alias("n"), (F.size("s_x") + F.size("s_y")).alias("all"))
    alike = alike.filter(F.col("n") >= ALIKE * (F.col("all") - F.col("n"))).select("a", "b")
    labels = cut(connected_components(ties.unionByName(alike)))
    rest = cut(open_pairs(rows, live, labels))
    if rest.isEmpty():
        return labels
    more = cut(_settled(rest, _sets(docs, ids(rest), id_col, text_col, small)))
    return cut(connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)))


def _shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as 64-bit hashes."""
    import xxhash

    tokens = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    found = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) > words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64).view(np.int64))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near copies: of its rows that with the least id, then fingerprint, then
    text.  Rows that share an id are told apart by their texts: a row goes only where a row like it stays.  Rows
    without an id stay: nothing could name another in their stead.  Null texts count as empty; texts of any length are
    compared whole; an empty table gives an empty one; all columns are kept.

    Grouped is what SimHash links, and also what resembles by 0.8 or more over five-word shingles: these differ in up
    to a dozen bits of the fingerprint, more than any ball could be hashed for."""
    named = docs.filter(F.col(id_col).isNotNull())
    prints = cut(with_fingerprint(named, id_col, text_col, words))
    labels = near_copy_labels(named, cut(links(prints.select("fp").distinct())), id_col, text_col, words)
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    joined = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    firsts = joined.groupBy("label").agg(F.min(F.struct("first_id", "fp")).alias("one")).select(F.col("one.first_id").alias("one_id"), F.col("one.fp").alias("one_fp"))
    many = prints.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(id_col).alias("one_id"))
    firsts = cut(firsts.join(many.withColumn("many", F.lit(True)), "one_id", "left"))
    only = named.join(firsts.filter("many is null").select("one_id"), F.col(id_col) == F.col("one_id"), "left_semi")
    # the few rows whose id occurs again: one of each wanted fingerprint
    repeated = firsts.filter("many").select("one_id", "one_fp").distinct()
    again = named.join(repeated.select("one_id").distinct(), F.col(id_col) == F.col("one_id"), "left_semi")
    told = with_fingerprint(again.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__t")), "__row", "__t", words)
    order = Window.partitionBy(f"__row.{id_col}", "fp").orderBy(f"__row.{text_col}")
    first = told.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    chosen = first.join(repeated, (F.col(f"__row.{id_col}") == F.col("one_id")) & (F.col("fp") == F.col("one_fp")), "left_semi").select("__row.*")
    return only.unionByName(chosen).unionByName(docs.filter(F.col(id_col).isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; see :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
