"""Aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.sources.tables import settle


def value_counts(df: DataFrame, column: str, k: int | None = None, share: bool = False) -> DataFrame:
    """``column, n`` (and ``share`` of all rows with a value), most frequent first, then by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if share:
        total = counts.agg(F.sum("n").alias("__all"))
        counts = counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))
    return counts if k is None else counts.orderBy(F.desc("n"), column).limit(k)


def bin_rare(df: DataFrame, source: str, into: str, keep: float = 0.8, other: str = "other") -> DataFrame:
    """``into``: the most frequent values of ``source`` whose shares together make up ``keep``, with the one that
    crosses it (the first at least); all others are ``other``, null stays null.  Equal counts go by value.

    Values are counted, and counts counted: of n rows at most the root of 2n different counts.  A running sum over
    these gives the count at which the share is crossed; values of greater count stay, and only those of that very
    count are put in order, in ranges, so that no task orders them all."""
    counts = settle(df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n")))
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum(F.col("n") * F.col("m")).over(before), F.lit(0)))
    total = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy())
    # how many values of each count stay: none once the share is reached, but the first of all
    quota = F.greatest(F.ceil((keep * total - F.col("above")) / F.col("n")), F.when(F.col("above") == 0, 1).otherwise(0))
    part = levels.withColumn("quota", quota).filter("quota > 0 and quota < m").select("n", "quota").first()
    least = levels.withColumn("quota", quota).filter("quota >= m").agg(F.min("n").alias("n")).first()["n"]
    chosen = counts.filter(F.col("n") >= least) if least is not None else counts.filter("false")
    if part is not None:
        ranged = settle(counts.filter(F.col("n") == part["n"]).repartitionByRange(source).withColumn("__p", F.spark_partition_id()))
        sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__m"))
        offset = F.coalesce(F.sum("__m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__p").orderBy(source))).join(sizes.select("__p", offset.alias("__o")), "__p")
        chosen = chosen.unionByName(placed.filter(F.col("__o") + F.col("__at") <= part["quota"]).select(*counts.columns))
    chosen = chosen.select(F.col(source).alias("__v"), F.lit(True).alias("__kept"))
    out = df.join(chosen, F.col(source) == F.col("__v"), "left")
    return out.withColumn(into, F.when(F.col(source).isNull(), None).when(F.col("__kept"), F.col(source).cast("string")).otherwise(F.lit(other))).drop("__v", "__kept")


#: How near, in shares of all rows, the values around the middle are bracketed at a time, and how many different values
#: reach the driver at last.
NARROW, FEW = 0.001, 10_000


def exact_quantiles(df: DataFrame, value: Column, ranks: list[int], narrow: float = NARROW, few: int = FEW) -> list[float]:
    """The values of ``ranks`` (from 1, ascending) among those that are not null, as doubles; NaN is the greatest.

    Each is bracketed by approximate quantiles, whose error has a bound, and rows strictly between are taken again,
    until these hold no more than ``few`` different values.  A pass is one aggregate with a buffer of fixed size; nothing
    is sorted or shuffled as a whole, and a value that very many rows share is met as a bracket's end."""
    rows = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    low = high = None  # strictly between these
    below, found = 0, {}
    wanted = sorted(set(ranks))
    while wanted:
        inside = rows if low is None else rows.filter((F.col("v") > low) & (F.col("v") < high))
        head = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(few + 1) if low is not None else None
        counts = head.collect() if head is not None else None  # at most `few` + 1 rows
        if counts is not None and len(counts) <= few:
            for r in counts:
                found |= {rank: r["v"] for rank in wanted if below < rank <= below + r["n"]}
                below += r["n"]
            return [found[r] for r in ranks]
        n = inside.count()
        share = [max(0.0, (wanted[0] - below) / n - narrow), min(1.0, (wanted[-1] - below) / n + narrow)]
        ends = inside.agg(F.percentile_approx("v", F.array(*map(F.lit, share)), int(4 / narrow)).alias("q")).first()["q"]
        a, b = F.lit(ends[0]), F.lit(ends[1])
        v = F.col("v")
        at = inside.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in {"under": v < a, "first": v == a, "between": (v > a) & (v < b), "last": (v == b) & (v > a)}.items()]).first()
        start = below + at["under"]
        for rank in wanted:
            if start < rank <= start + at["first"]:
                found[rank] = ends[0]
            elif start + at["first"] + at["between"] < rank <= start + at["first"] + at["between"] + at["last"]:
                found[rank] = ends[1]
        wanted = [r for r in wanted if r not in found]
        if wanted and not start < wanted[0] <= wanted[-1] <= start + at["first"] + at["between"] + at["last"]:
            raise ArithmeticError("a quantile lies out of its bracket")
        below, low, high = start + at["first"], a, b
    return [found[r] for r in ranks]


def exact_median(df: DataFrame, value: Column, n: int) -> float | None:
    """The mean of the two middle ones of ``n`` values that are not null; None without values."""
    if not n:
        return None
    first, second = exact_quantiles(df, value, [(n + 1) // 2, n // 2 + 1])
    return (first + second) / 2


def age_summary(df: DataFrame, column: str, days_per_year: float = 365.25) -> DataFrame:
    """One row: count, and min, max, mean, median and sample deviation in days and years, to six places.  The median is
    exact, by :func:`exact_quantiles`; without values all but the count are null."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    x, n = F.col(column), df.agg(F.count(column)).first()[0]
    median = F.lit(exact_median(df, x, n)).cast("double")
    whole = lambda v, m: {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": m, "std": F.stddev_samp(v)}
    in_years = F.lit(days_per_year)
    days = {f"{k}_days": F.round(v.cast("double"), 6) for k, v in whole(x, median).items()}
    years = {f"{k}_years": F.round(v.cast("double"), 6) for k, v in whole(x / in_years, median / in_years).items()}
    return df.agg(F.count(column).alias("n"), *[v.alias(k) for k, v in {**days, **years}.items()])


def duration_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max, mean, exact median and the share of rows with a value (null without rows)."""
    n = df.agg(F.count(column)).first()[0]
    return df.agg(
        F.count(column).alias("n"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.round(F.avg(column), 6).alias("mean"),
        F.round(F.lit(exact_median(df, F.col(column), n)).cast("double"), 6).alias("median"),
        F.round(F.try_divide(F.count(column), F.count(F.lit(1))), 6).alias("share"),
    )


def prior_service(df: DataFrame, received: str, start: str = "commission_date", end: str = "termination_date", drop: bool = False) -> DataFrame:
    """``total_service_days, service_count`` over column pairs ``start_N, end_N``: an end that is missing is the date
    received; pairs without a start or that end before it don't count; null if none does."""
    numbers = sorted(int(m[1]) for c in df.columns if (m := re.fullmatch(re.escape(start) + r"_(\d+)", c)))
    finish = lambda n: F.coalesce(F.col(f"{end}_{n}"), F.col(received)) if f"{end}_{n}" in df.columns else F.col(received)
    spans = F.array(*[F.datediff(finish(n), F.col(f"{start}_{n}")) for n in numbers]) if numbers else F.array().cast("array<int>")
    sound = F.filter(spans, lambda d: d >= 0)
    some = F.size(sound) > 0
    total = F.aggregate(sound, F.lit(0), lambda a, d: a + d)
    out = df.withColumns({"total_service_days": F.when(some, total), "service_count": F.when(some, F.size(sound))})
    return out.drop(*[f"{c}_{n}" for n in numbers for c in (start, end)]) if drop else out


def collapse_rare(df: DataFrame, column: str, least: int = 3, other: str = "Other") -> DataFrame:
    """Values with fewer rows than ``least`` become ``other`` (by a join with their counts: no hot value meets in a
    window)."""
    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rare = counts.filter(F.col("__n") < least).select("__v", F.lit(True).alias("__rare"))
    return df.join(rare, F.col(column) == F.col("__v"), "left").withColumn(column, F.when(F.col("__rare"), other).otherwise(F.col(column))).drop("__v", "__rare")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mean absolute error and R squared, to six places.  R squared of a constant target is 1 if it is met
    exactly and 0 if not; without rows both are null."""
    a, p = F.col(actual), F.col(predicted)
    residual, spread = F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a)
    constant = F.when(residual == 0, 1.0).when(residual.isNotNull(), 0.0)
    r2 = F.when(spread == 0, constant).otherwise(1 - F.try_divide(residual, spread))
    return df.agg(F.round(F.avg(F.abs(a - p)), 6).alias("mae"), F.round(r2, 6).alias("r2"))
