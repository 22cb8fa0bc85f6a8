"""Rules on what a text repeats within itself.

Repeated passages are found by a suffix array over code points.  Neighbours in it share their longest common prefix, and
the intervals of neighbours that share at least so many code points are the repeated substrings; each suffix is covered as
far as the deepest interval it is in reaches.  The union of these spans gives the covered fraction, the deepest interval
the longest repeat.  Simple counts over words and lines stand beside it.

A text without any equal windows of the least length has no such interval; its windows' hashes tell that without sorting
suffixes.  Equal windows have equal hashes, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, FEWEST, REPEATED = 5, 10, 20
#: Repeats count from so many code points on.  Fails: more than this part of the text covered, or a repeat that is as
#: long as this part of the text and as this many code points.
LEAST, COVERED, PART, LONG = 50, 0.3, 0.15, 200
#: Code points that are sorted together; a longer text is sorted alone.
TOGETHER = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
BLANKS = " \t\n\v\f\r"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` numbers, built from halves."""
    power, have, at, out = codes.astype(np.uint64) * _BASE + np.uint64(1), 1, 0, None
    base = _BASE
    while True:
        if width & have:
            part = power[at : len(codes) - width + 1 + at] if out is not None else power[: len(codes) - width + 1]
            out = part.copy() if out is None else out * base + part
            at += have
        have *= 2
        if have > width:
            return out
        power = power[: len(power) - have // 2] * base + power[have // 2 :]
        base = np.uint64((int(base) * int(base) | 1) & 0xFFFFFFFFFFFFFFFF)


def with_equal_windows(codes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Which of the texts, ``codes`` one after the other up to ``ends``, may have two equal windows: never too few."""
    some = np.zeros(len(ends), bool)
    if len(codes) < width:
        return some
    hashes = _windows(codes, width)
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = own[: len(hashes)] == own[width - 1 :]  # the window begins and ends in one text
    bits = max(1, int(len(ends) - 1).bit_length())
    hashes ^= hashes >> np.uint64(29)
    hashes *= _BASE
    keyed = np.sort(((hashes >> np.uint64(bits)) | (own[: len(hashes)].astype(np.uint64) << np.uint64(64 - bits)))[inside])
    some[(keyed[1:][keyed[1:] == keyed[:-1]] >> np.uint64(64 - bits)).astype(np.int64)] = True
    return some


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes, in order of text and then of code points; a suffix ends with its text.  Prefixes are
    compared in doubling lengths, and only those that still tie are sorted again."""
    n = len(codes)
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    letters = np.unique(codes)
    size = len(letters) + 1
    plain = np.searchsorted(letters, codes).astype(np.int64) + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # code points to the end of the text
    key, depth = own.astype(np.int64), 0
    most = len(ends)
    while most * size < 2**62 and depth < 16:
        nth = np.zeros(n, np.int64)
        nth[: max(0, n - depth)] = plain[depth:]
        nth[left <= depth] = 0
        key, most, depth = key * size + nth, most * size, depth + 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.empty(n, bool)
    start[:1] = True
    start[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[order] = group
    rank[n] = -1
    while True:
        single = start & np.append(start[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        who = order[tied]
        # a suffix that still ties has a code point at every depth so far; its text may end right there
        after = np.where(left[who] > depth, rank[np.minimum(who + depth, n)] + 1, 0)
        sub = np.argsort(group[tied] * (n + 1) + after, kind="stable")
        who, after, groups = who[sub], after[sub], group[tied]  # groups keep their places
        order[tied] = who
        start[tied] = np.append(True, (groups[1:] != groups[:-1]) | (after[1:] != after[:-1]))
        group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[who] = group[tied]
        depth *= 2


def _agree(codes: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many code points from ``a`` and from ``b`` on are equal, at most ``room``."""
    width = 8
    padded = np.append(codes, np.zeros(width, codes.dtype))
    words = np.lib.stride_tricks.sliding_window_view(padded, width)
    same = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live) > 64:
        at = same[live]
        equal = words[a[live] + at] == words[b[live] + at]
        run = np.where(equal.all(1), width, equal.argmin(1))
        same[live] = np.minimum(at + run, room[live])
        live = live[(run == width) & (same[live] < room[live])]
    for i in live:  # few and long: by parts that double
        x, y, most, step = int(a[i]), int(b[i]), int(room[i]), 64
        at = int(same[i])
        while at < most:
            step = min(step, most - at)
            differs = np.flatnonzero(codes[x + at : x + at + step] != codes[y + at : y + at + step])
            if len(differs):
                at += int(differs[0])
                break
            at, step = at + step, step * 2
        same[i] = at
    return same


def common_prefixes(codes: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in ``order``, how many code points its suffix shares with the one before (0 across texts).

    Compared are only suffixes whose code point before differs from that of their neighbour's; the suffix one further on
    otherwise shares one less.  The lengths compared so sum up to n log n at most."""
    n = len(codes)
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = order[0] if n else 0
    here = np.arange(n)
    pair = own[before] == own
    pair[order[:1]] = False
    first = np.zeros(n, bool)
    first[np.r_[0, ends[:-1]][np.diff(ends, prepend=0) > 0]] = True
    alone = ~pair | first | first[before]
    inner = ~alone
    alone[inner] = codes[here[inner] - 1] != codes[before[inner] - 1]
    end = np.repeat(ends, np.diff(ends, prepend=0))
    asked = here[alone & pair]
    shared = np.zeros(n, np.int64)
    shared[asked] = _agree(codes, asked, before[asked], np.minimum(end[asked] - asked, end[asked] - before[asked]))
    last = np.maximum.accumulate(np.where(alone, here, 0))
    shared = shared[last] - (here - last)
    return np.maximum(shared, 0)[order]


class Repeats(NamedTuple):
    """Of each text: covered code points, and the longest repeat."""

    covered: np.ndarray
    longest: np.ndarray


def repeats(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> Repeats:
    """Spans of substrings of at least ``least`` code points that a text holds twice or more (they may overlap)."""
    covered, longest = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    some = with_equal_windows(codes, ends, least)
    if not some.any():
        return Repeats(covered, longest)
    sizes = np.diff(ends, prepend=0)
    codes, ends = codes[np.repeat(some, sizes)], np.cumsum(sizes[some])
    own = np.repeat(np.arange(len(ends)), sizes[some])
    order = suffix_array(codes, ends)
    shared = common_prefixes(codes, ends, order)
    deepest = np.maximum(shared, np.append(shared[1:], 0))  # of the intervals that this suffix is in
    deep = deepest >= least
    starts, lengths = order[deep], deepest[deep]
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    inside = np.cumsum(edges[:-1]) > 0
    covered[some] = np.bincount(own[inside], minlength=len(ends))
    top = np.zeros(len(ends), np.int64)
    np.maximum.at(top, own[starts], lengths)
    longest[some] = top
    return Repeats(covered, longest)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words are in windows of ``width`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    seen: dict[tuple, int] = {}
    again = [False] * len(windows)
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            again[first] = again[i] = True
    if not any(again):
        return 0
    starts = np.flatnonzero(again)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """How many lines with a word are equal to an earlier one."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def judged(texts: list[str], least: int = LEAST) -> dict[str, np.ndarray]:
    """All counts of some texts together."""
    every = [code_points(t) for t in texts]
    sizes = np.array([len(c) for c in every], np.int64)
    ends, codes = np.cumsum(sizes), np.concatenate(every)
    low = np.minimum(codes, 255)
    own = np.repeat(np.arange(len(texts)), sizes)
    count = lambda mask: np.bincount(own[mask], minlength=len(texts))
    found = repeats(codes, ends, least)
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    # only texts with equal hashes of windows are looked at again, word by word
    hashes = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, int(n_words.sum()))
    again = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(with_equal_windows(hashes, np.cumsum(n_words), WINDOW)):
        again[i] = repeated_words(words[i])
    base_failed = (n_words < FEWEST) | (100 * again > REPEATED * n_words)
    fails = (found.covered > COVERED * sizes) | ((found.longest >= LONG) & (found.longest > PART * sizes))
    return {
        "n_words": n_words,
        "word_chars": count(~_SPACE[low]),
        "n_symbols": count(_SYMBOL[low]),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": again,
        "base_failed": base_failed,
        "kept": ~base_failed & ~fails,
        "n_repeat_chars": found.covered,
        "longest_repeat": found.longest,
    }


KINDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_repeat_chars long, longest_repeat long"


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: id, counts of words, symbols, repeated lines and words, whether these base rules fail, whether the text is
    kept, and how many code points repeats of ``least`` and more cover and how long the longest is.

    Null texts count as empty (no words, not kept).  A repeat's occurrences may overlap, so a text of one letter is
    covered whole.  Of equal rows each is judged; texts of any length are sorted whole, short ones together in parts of
    ``TOGETHER`` code points (about 100 bytes of memory each).  An empty table gives an empty one; other columns, whatever their names, are
    ignored.  Rows stay where they are: nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in KINDS.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("__id"), batch.column("__text").to_pylist()
            first = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= TOGETHER or i + 1 == len(texts):
                    got = judged(texts[first : i + 1], least)
                    yield pa.RecordBatch.from_arrays([ids[first : i + 1], *[pa.array(got[c]) for c in names]], ["__id", *names])
                    first, size = i + 1, 0

    plain = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return plain.mapInArrow(apply, f"__id {kind}, {KINDS}").withColumnRenamed("__id", id_col)


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition within every whole text of ``documents``; see :func:`repetition`."""
    return repetition(table(spark, sf_dir, "documents"))
