"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges up to which rounds take FEW partitions and send the minima (a row a node, 6 MB) to all tasks, whatever the session's number
#: of shuffle partitions: else nearly every task and shuffle file of a round holds nothing.
SMALL, FEW = 200_000, 8


def _weigh(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def _dealt(rows: DataFrame, small: bool) -> DataFrame:
    return rows.coalesce(FEW) if small else rows


def _to_minimum(arcs: DataFrame, keep, small: bool = False) -> DataFrame:
    """Each neighbour of ``a`` that ``keep`` admits is tied to the least of ``a`` and its neighbours."""
    least = _dealt(arcs.groupBy("a").agg(F.min("b").alias("low")), small).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
    tied = arcs.join(F.broadcast(least) if small else least, F.col("a") == F.col("hub")).filter(keep).select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = least.filter("hub > low").select(F.col("hub").alias("a"), F.col("low").alias("b"))
    return _dealt(tied.unionByName(own).filter("a != b").distinct(), small)


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``edges`` has two long columns ``a`` and ``b``; returns ``node, label``: each node of an edge with the least
    node of its component.  Self loops, repeated and null edges are ignored; no edges give an empty table.

    Every step is a grouped minimum (combined before the shuffle) and a join that adaptive execution may split when
    one node has very many edges.  Nothing but a count and a checksum reaches the driver."""
    now = cut(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _weigh(now)
    small = before[0] <= SMALL  # steps never add nodes
    now = _dealt(now, small)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_minimum(both, F.col("b") > F.col("a"), small)
        now = cut(_to_minimum(large, F.lit(True), small))
        after = _weigh(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(_dealt(labels.select(F.col("label").alias("node"), "label").distinct(), small))
