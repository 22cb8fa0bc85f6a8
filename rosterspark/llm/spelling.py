"""Spellings of one word: words an edit apart, told from each other by how often they occur.

Words become vectors that count their letters.  One replaced letter moves such a vector by exactly two, one inserted or
deleted letter by exactly one (sums of absolute differences).  Words of one length are split by a k-d tree over their
vectors; a word asks the trees of its own length and of the next one, and only boxes within reach are looked at.  What
lies at the right distance is compared letter by letter.

The tree has two stages.  Its upper planes are fitted on a bounded sample of words and only deal words out to tasks;
within a task the tree goes on over all words that were dealt there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, written

#: Letters of a deleted code point, one run of so many; least length and count of a word, and how many
#: times as often a form has to occur.
EVERY, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
#: Different words a task counts before it hands them on.
HELD = 500_000
#: Words of the sample that the upper planes are fitted on, how many of them a cell keeps at least, words of a cell on
#: average, and words of a leaf.
SAMPLE, SUPPORT, CELL, LEAF = 100_000, 8, 8192, 256
#: Cells of numbers that are compared at a time.
BLOCK = 1 << 22

#: By bytes of Latin-1: letters stay, A-Z lower-cased; all else, also what Latin-1 does not have, becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> Counter[bytes]:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, with how often they occur; Latin-1."""
    return Counter(text.encode("latin-1", "replace").translate(LETTERS).split())


def edited(run: bytes, prefix: int) -> bytes:
    """``run``, with a letter deleted if its checksum after ``prefix`` (that of its document's id and a colon) says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: words of ``shortest`` letters on that occur ``least`` times in all documents.  Counted within each
    task first, then by word."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, 64):
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                prefix = zlib.crc32(i.encode() + b":")
                for run, n in runs_of(t).items():
                    word = edited(run, prefix)
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) > HELD:
                yield out()
                total.clear()
        yield out()

    return plain.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Words(NamedTuple):
    """Words of one length: their letters as numbers, a row each, and how often each letter occurs."""

    letters: np.ndarray
    counts: np.ndarray

    def take(self, rows: np.ndarray) -> Words:
        return Words(self.letters[rows], self.counts[rows])


def numbers(words: list[str]) -> Words:
    """Letters by their place in the alphabet: a to z, then U+00C0 to U+00FF."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    letters = np.where(raw < 0xC0, raw - 97, raw - (0xC0 - 26)).astype(np.uint8)
    length = letters.shape[1]
    counts = np.zeros((len(words), 90), np.int16 if length < 2**14 else np.int32)
    for at in range(length):
        counts[np.arange(len(words)), letters[:, at]] += 1
    return Words(letters, counts)


class Node(NamedTuple):
    """A split of letter counts: up to ``most`` of ``letter`` go to ``low``.  Of a leaf, ``cell`` is its number."""

    letter: int
    most: int
    low: Node | None
    high: Node | None
    cell: int


def split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the rows most evenly; None if all are equal."""
    best, size = None, len(counts)
    for letter in np.flatnonzero(counts.min(0) != counts.max(0)):
        below = np.cumsum(np.bincount(counts[:, letter]))
        most = int(np.abs(below[:-1] - size / 2).argmin())
        evenness = min(below[most], size - below[most])
        if best is None or evenness > best[0]:
            best = (evenness, int(letter), most)
    return None if best is None or not best[0] else best[1:]


def planes(counts: np.ndarray, cells: int, first: int = 0) -> tuple[Node, int]:
    """A tree of about ``cells`` leaves of equally many sampled rows, numbered from ``first``; and the next free number."""
    found = split(counts) if cells > 1 and len(counts) >= 2 * SUPPORT else None
    if found is None:
        return Node(0, 0, None, None, first), first + 1
    letter, most = found
    below = counts[:, letter] <= most
    own = max(1, min(cells - 1, round(cells * below.mean())))
    low, first = planes(counts[below], own, first)
    high, first = planes(counts[~below], cells - own, first)
    return Node(letter, most, low, high, -1), first


def deal(node: Node, counts: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells and the rows that lie in them or within ``reach`` of them."""

    def down(node: Node, rows: np.ndarray, box: dict[int, tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        if box and len(rows):
            at = sum(np.maximum(lo - counts[rows, d], 0) + np.maximum(counts[rows, d] - hi, 0) for d, (lo, hi) in box.items())
            rows = rows[at <= reach]
        if not len(rows):
            return
        if node.low is None:
            yield node.cell, rows
            return
        lo, hi = box.get(node.letter, (0, np.iinfo(counts.dtype).max))
        yield from down(node.low, rows, {**box, node.letter: (lo, node.most)})
        yield from down(node.high, rows, {**box, node.letter: (node.most + 1, hi)})

    yield from down(node, np.arange(len(counts)), {})


def leaves(counts: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf of a k-d tree with LEAF rows at most, unless they are all equal."""
    out, todo = [], [np.arange(len(counts))]
    while todo:
        rows = todo.pop()
        found = split(counts[rows]) if len(rows) > LEAF else None
        if found is None:
            out.extend(rows[i : i + LEAF] for i in range(0, len(rows), LEAF))
            continue
        below = counts[rows, found[0]] <= found[1]
        todo += [rows[below], rows[~below]]
    return out


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b`` is ``a`` with one letter more: what both begin with and what both end with reaches over ``a``."""
    same = a == b[:, :-1]
    begins = np.where(same.all(1), a.shape[1], same.argmin(1))
    same = (a == b[:, 1:])[:, ::-1]
    ends = np.where(same.all(1), a.shape[1], same.argmin(1))
    return begins + ends >= a.shape[1]


def near_pairs(asks: Words, holds: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``asks`` and of ``holds`` that are one edit apart, each pair once: letters replaced if both have one
    length, else inserted into ``asks``."""
    longer = holds.letters.shape[1] - asks.letters.shape[1]
    reach, fits = (1, _inserted) if longer else (2, _replaced)
    if not len(asks.letters) or not len(holds.letters):
        return
    boxes = [(rows, holds.counts[rows].min(0), holds.counts[rows].max(0)) for rows in leaves(holds.counts)]
    low, high = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])
    for rows in leaves(asks.counts):
        mine = asks.counts[rows]
        least, most = mine.min(0), mine.max(0)
        gap = np.maximum(low - most, 0).sum(1) + np.maximum(least - high, 0).sum(1)
        for at in np.flatnonzero(gap <= reach):
            # of the rows in the leaf, those that come near the other leaf's box, and the other way round
            own = rows[(np.maximum(low[at] - mine, 0).sum(1) + np.maximum(mine - high[at], 0).sum(1)) <= reach]
            theirs = boxes[at][0]
            other = holds.counts[theirs]
            theirs = theirs[(np.maximum(least - other, 0).sum(1) + np.maximum(other - most, 0).sum(1)) <= reach]
            if not len(own) or not len(theirs):
                continue
            a, b = asks.counts[own], holds.counts[theirs]
            apart = np.zeros((len(own), len(theirs)), a.dtype)
            for letter in np.flatnonzero((np.maximum(a.max(0), b.max(0)) > np.minimum(a.min(0), b.min(0)))):
                apart += np.abs(a[:, letter, None] - b[None, :, letter])
            x, y = np.nonzero(apart == reach)
            x, y = own[x], theirs[y]
            each = max(1, BLOCK // holds.letters.shape[1])
            for i in range(0, len(x), each):
                p, q = x[i : i + each], y[i : i + each]
                good = fits(asks.letters[p], holds.letters[q])
                yield p[good], q[good]


def _summed(words: list[str], n: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """For each word with near ones: how many these are and which is the best (most frequent, then first)."""
    # by place in code-point order, so that the lesser place wins a tie; Latin-1 letters order as their text does
    order = np.argsort(np.array(words, object), kind="stable") if words else np.empty(0, np.int64)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    standing = np.lexsort((-place, n))  # the last is the best
    rank = np.empty(len(words), np.int64)
    rank[standing] = np.arange(len(words))
    many, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for a, b in found:
        np.add.at(many, a, 1)
        np.maximum.at(best, a, rank[b])
    some = np.flatnonzero(many)
    top = standing[best[some]]
    return pa.table({"word": pa.array([words[i] for i in some], pa.string()), "n_near": many[some], "top": pa.array([words[i] for i in top], pa.string()), "top_n": n[top]})


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word, n_near, top, top_n`` of those of ``words`` (``word, n``) that have near words: how many, and the most
    frequent (of equally frequent ones the first in code-point order) with its count.

    The planes by which words of one length are dealt to tasks come from a sample by hash of about ``sample`` words; words
    of a length that the sample lacks are one cell.  Letters alone place a word: words of equal letter counts share a leaf,
    however many they are, and are compared in parts."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    parts = -(-sum(sizes.values()) // sample) or 1
    per_length: dict[int, list[str]] = {}
    for r in words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == 0).collect():  # about `sample`
        per_length.setdefault(len(r["word"]), []).append(r["word"])
    trees: dict[int, Node] = {}
    for length, some in per_length.items():
        trees[length] = planes(numbers(some).counts, -(-sizes[length] // cell))[0]
    alone = Node(0, 0, None, None, 0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            words, n = batch.column("word").to_pylist(), batch.column("n")
            length_of = np.array([len(w) for w in words])
            for length in np.unique(length_of):
                own = np.flatnonzero(length_of == length)
                counts = numbers([words[i] for i in own]).counts
                # held by the cell they lie in; asking in all cells within reach, of their own length and of the next
                for of, reach, role in ((length, 0, 0), (length, 2, 1), (length + 1, 1, 1)):
                    if int(of) not in sizes:
                        continue
                    for number, rows in deal(trees.get(int(of), alone), counts, reach):
                        at = pa.array(own[rows])
                        many = len(rows)
                        columns = [pa.array(np.full(many, of), pa.int32()), pa.array(np.full(many, number), pa.int32()), pa.array(np.full(many, role), pa.int8()), batch.column("word").take(at), n.take(at)]
                        yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "role", "word", "n"])

    def search(group: pa.Table) -> pa.Table:
        of, role = group["length"][0].as_py(), group["role"].to_numpy()
        words, n = group["word"].to_pylist(), group["n"].to_numpy()
        holds = np.flatnonzero(role == 0)
        held = numbers([words[i] for i in holds])
        length_of = np.array([len(w) for w in words])

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for length in (of, of - 1):
                asks = np.flatnonzero((role == 1) & (length_of == length))
                if not len(asks) or not len(holds):
                    continue
                for a, b in near_pairs(numbers([words[i] for i in asks]), held):
                    yield asks[a], holds[b]
                    if length < of:
                        yield holds[b], asks[a]

        return _summed(words, n, found())

    cells = words.mapInArrow(dealt, "length int, cell int, role byte, word string, n long")
    parts = cells.groupBy("length", "cell").applyInArrow(search, "word string, n_near long, top string, top_n long")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), "top")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.top", (-F.col("best.less")).alias("top_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each of ``word, form``: the end of its chain of forms.  Chains are followed in doubling steps; a
    form occurs several times as often as its word, so there are few."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("mid"), F.col("root").alias("end"))
        moved = cut(links.join(further, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("went")))
        links = moved.drop("went")
        if not moved.filter("went").limit(1).count():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word that occurs ``least`` times in all documents: the near word
    that occurs most, if ``times`` as often as the word; the end of the chain of forms; how many near words there are.

    Null texts have no words, null ids count as empty in the checksum; repeated rows count each; ties among near words go
    to the first in code-point order; texts and words of any length are taken whole; an empty table gives an empty one;
    other columns, whatever their names, are ignored."""
    words = written(vocabulary(docs, id_col, text_col, least=least), "words")
    near = near_words(words, sample, cell)
    both = words.join(near, "word", "left")
    is_form = F.col("top_n") >= times * F.col("n")
    told = written(both.select("word", F.when(is_form, F.col("top")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top_n")).alias("form_n")), "forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of ``documents``; see :func:`spelling_variants`."""
    return spelling_variants(table(spark, sf_dir, "documents"))
