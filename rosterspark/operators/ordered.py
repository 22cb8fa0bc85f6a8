"""Scans in order within a key: what came before, what comes next, the best so far.

A key of very many rows is cut into ranges of its order, so that it is spread over tasks.  Each range is scanned on its
own and summed up in one row (its first, its last, its best); these few rows are scanned in turn, and what they carry is
joined back.  Keys of ordinary size are one range and cost one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.sources.tables import settle

#: Rows of a key from which on it is cut, and rows of a range then.
ROWS = 1_000_000


def known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], rows_each: int = ROWS, rows_of: DataFrame | None = None, at_most: int | None = None) -> DataFrame | None:
    """``df`` with ``__range``, numbers that ascend with ``order`` within each key of over ``rows_each`` rows (0 for the
    others), and ``__place``, which tells equal rows apart; None if no key has so many rows.  Keys that are null are not
    cut.  ``rows_of`` has the same keys with as many rows or more, where these are cheaper to count, and ``at_most`` is what
    no key's rows exceed; with few rows in all, keys are not counted.

    Only rows of such keys are dealt out by ranges.  They are settled then, so that a lost executor does not deal anew."""
    of = df if rows_of is None else rows_of
    if (of.count() if at_most is None else at_most) <= rows_each:
        return None
    counts = of.filter(known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    ranges = F.sum(F.when(F.col("__rows") > rows_each, F.ceil(F.col("__rows") / rows_each)))
    total = counts.agg(ranges).first()[0]
    if not total:
        return None
    hot = settle(counts.filter(F.col("__rows") > rows_each))
    own = [F.col(k) for k in keys]
    marked = settle(df.withColumn("__place", F.monotonically_increasing_id()).join(hot, keys, "left").select(*df.columns, "__place", F.col("__rows").isNotNull().alias("__hot")))
    dealt = marked.filter("__hot").repartitionByRange(int(total), *own, *order, F.col("__place"))
    cut = settle(dealt.withColumn("__range", F.spark_partition_id() + 1))
    return cut.unionByName(marked.filter("NOT __hot").withColumn("__range", F.lit(0))).drop("__hot")


def scanned(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    coming: dict[str, Column] | None = None,
    rows_each: int = ROWS,
    rows_of: DataFrame | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """``df`` with new columns by ``order`` (ascending, nulls first) within ``keys``: ``before`` and ``after`` have a
    value of the previous and of the next row, ``least`` the least value up to and with the row, ``last`` the last one up
    to it and ``coming`` the first one from it on that is not null.  A row with a null key is alone.  Rows that ``order`` does not tell apart come in any order."""
    before, after, least, last, coming = before or {}, after or {}, least or {}, last or {}, coming or {}
    ranged = in_ranges(df, keys, order, rows_each, rows_of, at_most)
    one = ranged is None
    rows = df.withColumns({"__place": F.monotonically_increasing_id(), "__range": F.lit(0)}) if one else ranged
    # a row without a key has the number of its own for one
    rows = rows.withColumn("__alone", F.when(known(keys), -1).otherwise(F.col("__place")))
    own = [*keys, "__alone", "__range"]
    by = Window.partitionBy(*own).orderBy(*order, *([] if one else ["__place"]))
    so_far, from_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    added = {n: F.lag(c).over(by) for n, c in before.items()} | {n: F.lead(c).over(by) for n, c in after.items()}
    added |= {n: F.min(c).over(so_far) for n, c in least.items()} | {n: F.last(c, ignorenulls=True).over(so_far) for n, c in last.items()}
    added |= {n: F.first(c, ignorenulls=True).over(from_here) for n, c in coming.items()}
    if one:
        return rows.withColumns(added).drop("__place", "__range", "__alone")
    added |= {"__first": F.lag(F.lit(True)).over(by).isNull(), "__final": F.lead(F.lit(True)).over(by).isNull()}
    local = rows.withColumns(added)

    at = F.struct(*order, F.col("__place"))
    ends = [F.max_by(c, at).alias(f"__{n}") for n, c in before.items()] + [F.min_by(c, at).alias(f"__{n}") for n, c in after.items()]
    ends += [F.min(c).alias(f"__{n}") for n, c in least.items()]
    ends += [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__{n}") for n, c in last.items()] + [F.min_by(c, F.when(c.isNotNull(), at)).alias(f"__{n}") for n, c in coming.items()]
    sums = rows.filter(F.col("__range") > 0).groupBy(*keys, "__range").agg(*ends)
    # as many rows as there are ranges
    along = Window.partitionBy(*keys).orderBy("__range")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    carried = {f"__{n}": F.lag(f"__{n}").over(along) for n in before} | {f"__{n}": F.lead(f"__{n}").over(along) for n in after}
    carried |= {f"__{n}": F.min(f"__{n}").over(earlier) for n in least} | {f"__{n}": F.last(f"__{n}", ignorenulls=True).over(earlier) for n in last}
    carried |= {f"__{n}": F.first(f"__{n}", ignorenulls=True).over(later) for n in coming}
    carry = sums.withColumns(carried)
    both = local.join(carry, [*keys, "__range"], "left")
    mended = {n: F.when(F.col("__first"), F.col(f"__{n}")).otherwise(F.col(n)) for n in before}
    mended |= {n: F.when(F.col("__final"), F.col(f"__{n}")).otherwise(F.col(n)) for n in after}
    smaller = lambda a, b: F.when(a.isNull() | (b < a), b).otherwise(a)
    mended |= {n: smaller(F.col(n), F.col(f"__{n}")) for n in least} | {n: F.coalesce(n, f"__{n}") for n in [*last, *coming]}
    return both.withColumns(mended).select(*df.columns, *before, *after, *least, *last, *coming)
