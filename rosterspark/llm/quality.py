"""Text quality by a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts; every path from a root down to a node is a conjunctive rule
over the statistics.  A logistic model with an absolute-value penalty weighs the rules and keeps few of them, and what
is left is compiled into a Spark column expression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, reserved, table

#: What is known of a text.
STATISTICS = (
    "log_words",
    "word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "non_ascii_share",
    "end_mark_share",
    "symbol_word_share",
    "lone_symbol_share",
    "upper_word_share",
    "short_word_share",
    "long_word_share",
    "distinct_word_share",
    "top_word_share",
    "distinct_line_share",
    "words_per_line",
    "words_per_end_mark",
)

_LETTER_UP = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_END = np.array([chr(i) in ".?!" for i in range(256)])
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE) & np.array([chr(i) not in ".,;:?!'\"-()" for i in range(256)])


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers named in STATISTICS; all zero but none missing for an empty or null text."""
    raw = ("" if text is None else text).encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n = len(words)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    letters, size = max(1, counts[_LETTER].sum()), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    # which bytes begin and end words, and running totals to count within words
    gaps = _SPACE[data]
    ends = np.flatnonzero(np.append(gaps[1:], True) & ~gaps)
    starts = np.flatnonzero(np.insert(gaps[:-1], 0, True) & ~gaps)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    symbols, ups, alphas = (t[ends + 1] - t[starts] for t in map(total, (_SYMBOL, _LETTER_UP, _LETTER)))
    marks = int(_END[data[ends]].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        math.log1p(n),
        float(lengths.mean()),
        float(counts[_LETTER_UP].sum() / letters),
        float(counts[_DIGIT].sum() / size),
        float(counts[_SYMBOL].sum() / size),
        float(counts[128:].sum() / size),
        marks / n,
        float((symbols > 0).mean()),
        float(((symbols > 0) & (alphas == 0)).mean()),
        float(((ups == alphas) & (ups > 1)).mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        n / (marks + 1),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in STATISTICS]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS))

    return docs.withColumn(into, of(F.coalesce(F.col(text_col), F.lit(""))))


#: A test of a statistic: number, whether at most (else above), bound.
Test = tuple[int, bool, float]


@dataclass(frozen=True)
class Rules:
    """A logistic score: ``base`` and the weights of conjunctions of tests that hold."""

    base: float
    weights: tuple[tuple[float, tuple[Test, ...]], ...] = ()

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.base)
        for weight, tests in self.weights:
            total = total + F.when(holds(tests, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(tests: tuple[Test, ...], stats: str) -> Column:
    out = F.lit(True)
    for number, below, bound in tests:
        value = F.col(f"{stats}.{STATISTICS[number]}")
        out = out & (value <= bound if below else value > bound)
    return out


def paths(tree: str) -> list[tuple[Test, ...]]:
    """Conjunctions of all paths from the root to a node, from the printed form of a fitted tree."""
    out, open_ = [], []
    for line in tree.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            open_.append((depth, (int(found[2]), found[3] == "<=", float(found[4]))))
            out.append(tuple(sorted(t for _, t in open_)))
    return out


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.001, least_weight: float = 1e-3) -> Rules:
    """``rows``: ``stats`` and ``label`` (0 or 1).  With no row or a single label the score is a constant."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
    if not good or not bad:
        return Rules(math.log((good + 0.5) / (bad + 0.5)))
    vectors = rows.select("label", "stats", array_to_vector(F.array(*[F.col(f"stats.{n}") for n in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=5).fit(vectors)
    rules = sorted({p for tree in forest.trees for p in paths(tree.toDebugString)})
    if not rules:
        return Rules(math.log(good / bad))
    facts = cut(rows.select("label", array_to_vector(F.array(*[holds(r, "stats").cast("double") for r in rules])).alias("features")))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(facts)
    weights = tuple((float(w), r) for w, r in zip(model.coefficients.toArray(), rules) if abs(w) >= least_weight)
    return Rules(float(model.intercept), weights)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """Rules from at most ``sample`` labelled documents outside the held-out fold, those of least hashed id.  Null
    labels don't count; of several labels of a document the greatest does, of several texts of it the least."""
    train = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).filter(fold(id_col) != 0)
    chosen = train.groupBy(id_col).agg(F.max("quality").cast("double").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    # `sample` bounds the broadcast side
    some = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(F.broadcast(chosen), id_col)
    some = some.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max("label").alias("label"))
    dealt = some.repartition(4, id_col).sortWithinPartitions(id_col)
    # the sample is small: each pass of the fits over it takes four tasks, though the session may deal it to more
    return fit(cut(with_statistics(dealt, text_col).select("label", "stats")).coalesce(4))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    Null texts score as empty ones, by what the rules say of a text without words.  A null id is in no fold that is
    held out unless the empty text's is.  Repeated rows score alike; an empty table gives an empty one."""
    rules = learn(docs, labels, sample, id_col, text_col)
    scored = with_statistics(reserved(docs, "held_out", "score", "predicted", "__stats"), text_col, "__stats").withColumn("score", rules.score("__stats"))
    return scored.withColumn("held_out", fold(id_col) == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__stats")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are: columns of any name stay.  Every row is
    judged by its own whole text, null as empty; an empty table gives an empty one."""
    rules = learn(docs, labels, id_col=id_col, text_col=text_col)
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__t"))
    return with_statistics(held, "__t", "__stats").filter(rules.score("__stats") >= threshold).select("__row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``; see :func:`score`.  Equal texts score alike."""
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
