"""Code lengths of texts by context-tree weighting over bytes, beside a smoothed unigram model of words.

A text is its UTF-8 bytes with A-Z in lower case, white space as it is, and one end sign; what comes before its first
byte are end signs.  Every byte is predicted as eight binary decisions from the ``DEPTH`` bytes before it, wherever
words begin.  For every context and decision there is a Krichevsky-Trofimov estimate from the counts of the training
texts, and the estimates of all depths are mixed by the weights that context-tree weighting gives them: half the prior
weight for stopping at a context, half for going on to the contexts one byte longer.

A gram is a context of full depth and the byte after it.  Texts are kept in blocks of bounded size; a block asks once
for each gram and each word it holds, however often these occur there, and says how often they occur in its training
texts.  So nothing is hot: a gram is asked for at most once by each block.  From the summed counts the tree is worked
through a depth at a time, upwards for the block probabilities and downwards for the mixtures: the deepest levels
within the groups that share four context bytes (in slices, many groups at a time), the others as Spark aggregates by
context and decision, of which only depths zero and one (at most 256 x 255 sums) reach the driver.  The answers go back
to the blocks, where whole texts are summed up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, cut, fold, slices, table, written

DEPTH = 6
#: Levels from this depth on are worked through within groups of equal contexts of this depth.
STEM = 4
#: Bytes of text in a block, positions handled at a time, and keys that wait to be merged.
BLOCK = 56 << 20
WINDOW, ROOM = 1 << 18, 1 << 20
#: No byte of UTF-8: ends a text and stands before its first byte.
END = 0xFF
#: How the end sign is counted among the words; no word holds white space.
END_WORD = b"\n"
_STIRLING = 64
_STEPS = range(8)


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(n + plus) for whole n >= 0."""
    small = np.array([math.lgamma(i + plus) for i in range(_STIRLING)])
    x = np.maximum(n + plus, 1.0)
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _STIRLING, small[np.minimum(n, _STIRLING - 1).astype(np.int64)], large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimate."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def coded(text: str | None) -> bytes:
    """The bytes that are coded: A-Z in lower case, nothing else changed."""
    return ("" if text is None else text).encode("utf-8", "replace").lower()


def grams(texts: list[bytes], depth: int = DEPTH, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grams of ``texts`` and the number of the text each is from, at most ``window`` at a time.  A gram is packed
    into a whole number: the context, nearest byte highest, then the predicted byte; so in order of their numbers, grams
    that share a context of any depth are neighbours."""
    pad = bytes([END]) * depth
    line = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
    sizes = np.array([len(t) + depth for t in texts], np.int64)
    first = depth + np.cumsum(sizes) - sizes
    coded_here = np.zeros(len(line), bool)
    for at, size in zip(first.tolist(), sizes.tolist()):
        coded_here[at : at + size - depth + 1] = True
    owner = np.repeat(np.arange(len(texts)), sizes)
    for at in range(depth, len(line), window):
        end = min(at + window, len(line))
        packed = np.zeros(end - at, np.int64)
        for k in range(depth + 1):
            packed |= line[at - k : end - k].astype(np.int64) << (8 * (depth - k + 1) if k else 0)
        here = coded_here[at:end]
        yield packed[here], owner[at - depth : end - depth][here]


def word_keys(words: Sequence[bytes]) -> np.ndarray:
    """Keys of words: 63 bits of a hash, negative so that they are apart from grams.  (Of a billion different words,
    two sharing a key are expected at odds of one to twenty.)"""
    import xxhash

    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (hashed | np.uint64(1 << 63)).view(np.int64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the different words of ``texts``, which of them each word is, and how many words each text has.  Cut by
    Arrow at the same six characters as ``bytes.split``; no object is made but of the different words."""
    cut_up = pa.compute.ascii_split_whitespace(pa.array(texts, pa.string()))
    flat, ends = cut_up.flatten(), cut_up.offsets.to_numpy()
    full = pa.compute.binary_length(flat).to_numpy() > 0  # white space at an end or in a row leaves empty pieces
    upto = np.concatenate([[0], np.cumsum(full)])
    found = flat.filter(pa.array(full)).dictionary_encode()
    words = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return word_keys(words), found.indices.to_numpy(), upto[ends[1:]] - upto[ends[:-1]]


class Tally:
    """Different keys with their counts.  Raw keys are merged in whenever there are ``room``, in parts of the range of
    keys one after another, so that what is sorted at once stays small."""

    def __init__(self, room: int = ROOM, parts: int = 16):
        self.room, self.raw, self.waiting = room, [], 0
        self.parts, self.bounds = parts, np.empty(0, np.int64)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64))]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` in order."""
        self.raw.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > self.room:
            self.merge()

    def count(self, keys: np.ndarray, weight: int) -> None:
        """Adds every one of ``keys`` (sorted in place) as ``weight``."""
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
        self.add(keys[at], np.diff(at, append=len(keys)) * weight)

    def merge(self) -> None:
        cuts = [[0, *np.searchsorted(keys, self.bounds), len(keys)] for keys, _ in self.raw]
        for part, (own, times) in enumerate(self.held):
            some = [(k[c[part] : c[part + 1]], n[c[part] : c[part + 1]]) for (k, n), c in zip(self.raw, cuts)]
            keys, counts = (np.concatenate(x) for x in zip((own, times), *some))
            if len(keys):
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
                self.held[part] = keys[at], np.add.reduceat(counts[order], at)
        self.raw, self.waiting = [], 0
        if not len(self.bounds) and len(self.held[0][0]) > self.parts:
            keys, counts = self.held[0]
            at = np.arange(1, self.parts) * len(keys) // self.parts
            self.bounds = keys[at]
            self.held = [(k.copy(), n.copy()) for k, n in zip(np.split(keys, at), np.split(counts, at))]


class Lookup:
    """Values of different keys, found by hash: a random place in a long sorted array costs seven times as much."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        hashed = self._hash(keys)
        order = np.argsort(hashed, kind="stable")
        self.keys, self.values, hashed = keys[order], values[order], hashed[order]
        self.start = np.empty(1 << bits, np.int32)
        for at in range(0, 1 << bits, ROOM):  # in parts: places are whole longs until they are put away
            end = min(at + ROOM, 1 << bits)
            self.start[at:end] = np.searchsorted(hashed, np.arange(at, end, dtype=np.uint64))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All ``keys`` must be there."""
        at = self.start[self._hash(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def _schema(**fields: str) -> T.StructType:
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """``i, t, held, block``: the rows in blocks of about ``block`` bytes of text at most (a longer text is a block by
    itself), written once, so that both passes see the same blocks, and dealt by block."""
    plain = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (fold(id_col) == 1).alias("held"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // block))
    schema = T.StructType([*plain.schema.fields, T.StructField("block", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, full = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches):
            numbers = []
            for length in pa.compute.binary_length(batch.column("t")).to_pylist():
                if full and full + length > 2 * block:
                    n, full = n + 1, 0
                full += length
                numbers.append(own | n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], schema.names)

    # more buckets than blocks, so that few blocks share one
    return bucketed(plain.coalesce(parts).mapInArrow(number, schema), 3 * parts, ("block",), "lm_blocks")


def asked(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``stem, rest, n, block``: each different gram and word of a block and how often training texts there have it.
    Keys are cut in two: ``stem``, of a gram the nearest context, by which the rows are dealt, and ``rest``."""
    schema = _schema(key="long", n="long", block="long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tally, end = None, Tally(), word_keys([END_WORD])

        def hand_on() -> Iterator[pa.RecordBatch]:
            tally.merge()
            for keys, n in tally.held:
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(n[part]), pa.array(np.full(len(keys[part]), number))], schema.names)

        for batch in slices(batches, 256):
            theirs = _column(batch, "block")
            for own in dict.fromkeys(theirs.tolist()):
                if own != number:
                    if number is not None:
                        yield from hand_on()
                    number, tally = own, Tally()
                part = batch.filter(pa.array(theirs == own))
                for held, weight in ((False, 1), (True, 0)):
                    texts = [coded(t) for t, h in zip(part.column("t").to_pylist(), part.column("held").to_pylist()) if h == held]
                    if not texts:
                        continue
                    keys, which, _ = words_of(texts)
                    order = np.argsort(keys)
                    tally.add(keys[order], np.bincount(which, minlength=len(keys))[order] * weight)
                    tally.add(end, np.array([len(texts) * weight]))
                    for keys, _ in grams(texts, depth):
                        tally.count(keys, weight)
        if number is not None:
            yield from hand_on()

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_at = _rest_bits(depth)
    rows = blocks.select("t", "held", "block").mapInArrow(apply, schema)
    rows = rows.select(F.shiftright("key", cut_at).alias("stem"), F.col("key").bitwiseAND(F.lit((1 << cut_at) - 1)).cast("int").alias("rest"), "n", "block")
    return bucketed(rows.repartition(parts, "stem", "rest"), parts, ("stem", "rest"), "lm_asked")


def _rest_bits(depth: int) -> int:
    return 8 * (depth - min(STEM, depth)) + 8


def _keys(rows: pa.Table, depth: int) -> np.ndarray:
    return rows.column("stem").to_numpy() << _rest_bits(depth) | rows.column("rest").to_numpy()


def subtree(packed: np.ndarray, counts: np.ndarray, depth: int, stem: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Works through all grams of some contexts of depth ``stem``, in order: by gram and step the probability of a set bit as
    mixed from depth ``stem`` on, and of each such context and decision the counts and the log of the weighted block
    probability."""
    byte, n = packed & 0xFF, counts.astype(np.float64)
    chance = np.empty((len(packed), 8))
    nodes: dict[str, list[np.ndarray]] = {c: [] for c in ("context", "node", "zeros", "ones", "block")}
    for step in _STEPS:
        node, bit = 1 << step | byte >> 8 - step, byte >> 7 - step & 1
        mixed, below = np.full(len(packed), 0.5), None
        for d in range(depth, stem - 1, -1):
            keys, own = np.unique(packed >> 8 * (depth - d) + 8 << 8 | node, return_inverse=True)
            ones, both = (np.bincount(own, weights=w, minlength=len(keys)) for w in (n * bit, n))
            stop = log_kt(both - ones, ones)
            block, weight = stop, np.ones(len(keys))
            if below is not None:
                parent = np.searchsorted(keys, below[0] >> 16 << 8 | below[0] & 0xFF)
                block = np.logaddexp(stop, np.bincount(parent, weights=below[1], minlength=len(keys))) - math.log(2)
                weight = np.exp(np.minimum(0.0, stop - math.log(2) - block))
            mixed = weight[own] * ((ones + 0.5) / (both + 1.0))[own] + (1 - weight[own]) * mixed
            below = (keys, block)
        chance[:, step] = mixed
        for name, column in zip(nodes, (keys >> 8, keys & 0xFF, both - ones, ones, block)):
            nodes[name].append(column)
    return chance, {name: np.concatenate(columns) for name, columns in nodes.items()}


def _by_stem(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Sorted batches put together and cut where ``stem`` changes: about ``rows`` rows at a time, whole stems."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held)
            stems = whole.column("stem").to_numpy()
            at = int(np.searchsorted(stems, stems[-1]))
            if at:
                yield whole.slice(0, at)
            held, size = whole.slice(at).to_batches(), whole.num_rows - at
    if size:
        yield pa.Table.from_batches(held)


_NODES = _schema(context="long", node="int", zeros="double", ones="double", block="double")
_LEVEL = _schema(context="long", node="int", zeros="double", ones="double", block="double", weight="double", kt="double")


def _weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts and decisions with these counts and this sum over their longer contexts: block probability (log),
    weight of stopping there, and chance of a set bit."""
    stop = log_kt(zeros, ones)
    block = np.logaddexp(stop, below) - math.log(2)
    return block, np.exp(np.minimum(0.0, stop - math.log(2) - block)), (ones + 0.5) / (zeros + ones + 1.0)


def _sums(nodes: DataFrame) -> DataFrame:
    """Nodes summed for the contexts one byte shorter."""
    return nodes.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "block")])


def _level(nodes: DataFrame) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, weight, kt = _weighed(*(_column(batch, c) for c in ("zeros", "ones", "block")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("context", "node", "zeros", "ones")), pa.array(block), pa.array(weight), pa.array(kt)], _LEVEL.names)

    return cut(_sums(nodes).mapInArrow(apply, _LEVEL))


def _top(nodes: DataFrame) -> DataFrame:
    """``context, node, sure, open`` at depth one: what depths zero and one give to the chance of a set bit, and the
    weight that is left for longer contexts.  At most 256 x 255 rows, made on the driver."""
    spark = nodes.sparkSession
    rows = _sums(nodes).toArrow()
    near, node, zeros, ones, below = (rows.column(c).to_numpy() for c in ("context", "node", "zeros", "ones", "block"))
    block, weight, kt = _weighed(zeros, ones, below)
    root = [np.bincount(node, weights=w, minlength=256) for w in (zeros, ones, block)]
    _, weight0, kt0 = _weighed(*root)
    sure = weight0[node] * kt0[node] + (1 - weight0[node]) * weight * kt
    left = (1 - weight0[node]) * (1 - weight)
    schema = _schema(context="long", node="int", sure="double", open="double")
    return spark.createDataFrame(pa.table([pa.array(c) for c in (near.astype(np.int64), node.astype(np.int32), sure, left)], names=schema.names), schema)


def _under(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` with ``sure`` and ``open`` of the context one byte shorter that each is in."""
    up = above.select(F.col("context").alias("up"), F.col("node").alias("up_node"), "sure", "open")
    return rows.join(up, (F.shiftright("context", 8) == F.col("up")) & (F.col("node") == F.col("up_node"))).drop("up", "up_node")


def gram_scores(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``stem, rest, lp``: log10 probability of the predicted byte of each gram of ``counted`` (``stem, rest, n``), also
    of those without training counts."""
    stem = min(STEM, depth)
    leaves = counted.filter("stem >= 0")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_stem(batches):
            _, nodes = subtree(_keys(part, depth), part.column("n").to_numpy(), depth, stem)
            nodes["node"] = nodes["node"].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[c]) for c in _NODES.names], _NODES.names)

    nodes = cut(leaves.repartition("stem").sortWithinPartitions("stem", "rest").mapInArrow(up, _NODES))
    levels, longer = {}, nodes
    for d in range(stem - 1, 1, -1):
        levels[d] = longer = _level(longer)
    above = _top(longer)
    for d in range(2, stem):
        own = _under(levels[d], above)
        above = own.select("context", "node", (F.col("sure") + F.col("open") * F.col("weight") * F.col("kt")).alias("sure"), (F.col("open") * (1 - F.col("weight"))).alias("open"))
    settled = _under(nodes.select("context", "node"), above)
    none = F.lit(None)
    rows = leaves.select("stem", "rest", "n", none.cast("int").alias("node"), none.cast("double").alias("sure"), none.cast("double").alias("open")).unionAll(
        settled.select(F.col("context").alias("stem"), none.cast("int").alias("rest"), none.cast("long").alias("n"), "node", "sure", "open")
    )
    out = _schema(stem="long", rest="int", lp="float")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_stem(batches):
            leaf = part.column("rest").is_valid().to_numpy()
            own, given = part.filter(pa.array(leaf)), part.filter(pa.array(~leaf))
            packed = _keys(own, depth)
            chance, _ = subtree(packed, own.column("n").to_numpy(), depth, stem)
            names = given.column("stem").to_numpy() << 8 | given.column("node").to_numpy()
            order = np.argsort(names)
            names, sure, left = names[order], given.column("sure").to_numpy()[order], given.column("open").to_numpy()[order]
            byte, lp = packed & 0xFF, np.zeros(len(packed))
            for step in _STEPS:
                at = np.searchsorted(names, own.column("stem").to_numpy() << 8 | 1 << step | byte >> 8 - step)
                one = sure[at] + left[at] * chance[:, step]
                lp += np.log10(np.where(byte >> 7 - step & 1 == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(own.column("stem").to_numpy()), pa.array(own.column("rest").to_numpy()), pa.array(lp.astype(np.float32))], out.names)

    return rows.repartition("stem").sortWithinPartitions("stem", "rest").mapInArrow(down, out)


def scored_texts(texts: list[bytes], find: Callable[[np.ndarray], np.ndarray], depth: int) -> np.ndarray:
    """log10 probability of each text, from those of its grams."""
    sums = np.zeros(len(texts))
    for keys, owner in grams(texts, depth):
        sums += np.bincount(owner, weights=find(keys), minlength=len(texts))
    return sums


def _laid(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, first all lowest bytes: what ordered numbers share is then easy to compress."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unlaid(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32)


def _joined(given: pa.Table, column: str, kind: Callable[[bytes], np.ndarray]) -> np.ndarray:
    return np.concatenate([kind(x) for x in given.column(column).to_pylist()])


def packed_by_block(replies: DataFrame, depth: int, rows: int = 1 << 20) -> DataFrame:
    """``block, grams, lps, words, times``: the answers to a block as arrays, of about ``rows`` answers at a time."""
    names = ("grams", "lps", "words", "times")
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in names)])

    def pack(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        block = whole.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        ends = np.flatnonzero(np.diff(block[order], append=block.max() + 1)) + 1
        keys, lp, n = _keys(whole, depth), whole.column("lp").fill_null(0).to_numpy(), whole.column("n").fill_null(0).to_numpy()
        for of in np.split(order, ends[:-1]):
            gram, word = of[keys[of] >= 0], of[keys[of] < 0]
            parts = (_laid(keys[gram]), lp[gram].astype(np.float32).tobytes(), _laid(keys[word]), _laid(n[word]))
            yield pa.RecordBatch.from_arrays([pa.array([block[of[0]]]), *(pa.array([p], pa.binary()) for p in parts)], schema.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pack(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from pack(pa.Table.from_batches(held))

    return replies.select("block", "stem", "rest", "lp", "n").mapInArrow(apply, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the
    text and its end) and bits_per_byte (code length per coded byte, the end counted as one).

    Trains on the rows whose fold is not 1.  Null texts count as empty (the end sign alone); a row with a null id is in
    the fold of the empty text; repeated rows train and score as often as they are there; texts of any length are
    coded whole; with no training row all counts are zero and every bit has a chance of one half.  An empty table
    gives an empty one; other columns, whatever their names, are ignored."""
    if not 2 <= depth <= 6:
        raise ValueError("contexts have two to six bytes")
    blocks = in_blocks(docs, id_col, text_col, block)
    requests = asked(blocks, depth)
    counted = written(requests.groupBy("stem", "rest").agg(F.sum("n").alias("n")), "lm_counted")
    row = counted.filter("stem < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    tokens, kinds = row["tokens"], row["kinds"]
    none = F.lit(None)
    answers = gram_scores(counted, depth).select("stem", "rest", "lp", none.cast("long").alias("n"))
    answers = answers.unionAll(counted.filter("stem < 0").select("stem", "rest", none.cast("float").alias("lp"), "n"))
    replies = packed_by_block(requests.select("stem", "rest", "block").join(answers, ["stem", "rest"]), depth)
    schema = T.StructType(
        [
            T.StructField("i", docs.schema[id_col].dataType),
            T.StructField("held", T.BooleanType()),
            *_schema(tokens="long", known="long", base="double", score="double", size="long").fields,
        ]
    )

    def settle(own: pa.Table, given: pa.Table) -> pa.Table:
        lp_of, times_of = (Lookup(_joined(given, keys, _unlaid), _joined(given, values, kind)) for keys, values, kind in (("grams", "lps", _floats), ("words", "times", _unlaid)))
        out, ends = [], times_of(word_keys([END_WORD]))[0]
        for batch in slices(own.to_batches(), 256):
            texts = [coded(t) for t in batch.column("t").to_pylist()]
            score = scored_texts(texts, lp_of, depth)
            keys, which, n = words_of(texts)
            n, c = n + 1, times_of(keys)[which]
            owner = np.repeat(np.arange(len(texts)), n - 1)
            known = np.bincount(owner, weights=c > 0, minlength=len(texts)).astype(np.int64) + (ends > 0)
            chance = np.log10((np.append(c, ends) + 0.5) / (tokens + 0.5 * (kinds + 1)))
            base = np.bincount(owner, weights=chance[:-1], minlength=len(texts)) + chance[-1]
            size = np.array([len(t) + 1 for t in texts], np.int64)
            out.append(pa.RecordBatch.from_arrays([batch.column("i"), batch.column("held"), *map(pa.array, (n, known, base, score, size))], schema.names))
        return pa.Table.from_batches(out)

    met = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settle, schema)
    return met.select(
        F.col("i").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (F.col("score") * -math.log2(10) / F.col("size")).alias("bits_per_byte"),
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of ``documents``; see :func:`score_documents`."""
    return score_documents(table(spark, sf_dir, "documents"))
