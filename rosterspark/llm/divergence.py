"""How far the sources of a language are from each other in what terms they use.

Counts of terms become integer shares (parts of a thousand million, smoothed), so all sums are exact.  The index is kept
by term: who holds a term, and with what share.  A source is compared with all peers by row accumulation: it walks its
own terms, and each term's holders get their difference added in a dense row, one place a peer.  What a peer or the
source itself does not hold counts with the share of an absent term; these baselines are summed apart, from the sorted
shares of each source, and corrected where both hold a term.  No pair of postings becomes a row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written

#: What a share is a part of, and what every count is raised by.
WHOLE, RAISE = 1_000_000_000, 5
#: In how many documents of its language a term occurs to be kept, and how many terms of a group are listed.
LEAST, TERMS = 30, 50
#: Different (group, term) a task counts before it hands them on; rows of accumulators that are held at a time.
HELD, ROWS = 400_000, 1024
#: Postings of a block on average: as many as its accumulators have places, but within these bounds.
FEW, MANY = 1 << 15, 1 << 22

UPPER = bytes(range(65, 91))
#: By bytes of UTF-8: what can't be in a term becomes a blank, A-Z the lower letter, all else stays.
PLAIN = bytes(c + 32 if c in UPPER else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters A-Z (lower-cased) and characters beyond ASCII, as UTF-8."""
    return ("" if text is None else text).encode().translate(PLAIN).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents, one row for each task that met the term there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter] = defaultdict(Counter)
        holds: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in uses.items():
                d = holds[lang, source]
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang), size),
                        pa.repeat(pa.scalar(source), size),
                        pa.array(list(n), pa.binary()).cast(pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([d[t] for t in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "d"],
                )
            uses.clear()
            holds.clear()

        for batch in batches:
            for part in slices([batch], 64):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    terms = terms_of(text)
                    uses[lang, source].update(terms)
                    holds[lang, source].update(set(terms))
                if sum(map(len, uses.values())) > HELD:
                    yield from out()
        yield from out()

    return plain.mapInArrow(counted, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term with ``count`` occurrences among ``total`` of ``terms`` terms: exact, in decimals."""
    big = lambda c: c.cast("decimal(19,0)")
    top = F.lit(WHOLE).cast("decimal(10,0)") * big(count + RAISE)
    return (F.floor((top - top % big(total + RAISE * terms)) / big(total + RAISE * terms)) + 1).cast("long")


def _accumulate(term: np.ndarray, who: np.ndarray, p: np.ndarray, absent: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums of differences over the terms of a block: rows ``first`` to ``last`` of all groups against all.  ``term, who,
    p``: postings; ``absent``: each group's share of a term it does not hold."""
    by_term = np.argsort(term, kind="stable")
    holder, held = who[by_term], p[by_term]
    n_terms = int(term.max()) + 1 if len(term) else 0
    at = np.searchsorted(term[by_term], np.arange(n_terms + 1))
    by_group = np.argsort(who, kind="stable")
    rows = np.searchsorted(who[by_group], np.arange(len(absent) + 1))
    out = n_terms * np.abs(absent[first:last, None] - absent[None, :])
    for s in range(len(absent)):
        own = by_group[rows[s] : rows[s + 1]]
        if not len(own):
            continue
        mine = np.sort(p[own])
        sums = np.concatenate([[0], np.cumsum(mine)])

        def moved(x: np.ndarray) -> np.ndarray:
            """What holding its terms adds for this group, against one that holds none and whose share is ``x``."""
            below = np.searchsorted(mine, x)
            return sums[-1] - 2 * sums[below] - x * (len(mine) - 2 * below) - len(mine) * np.abs(absent[s] - x)

        out[:, s] += moved(absent[first:last])
        if not first <= s < last:
            continue
        row = out[s - first]
        row += moved(absent)
        many = at[term[own] + 1] - at[term[own]]
        ends = np.cumsum(many)
        place = np.repeat(at[term[own]] - ends + many, many) + np.arange(ends[-1])
        peer, theirs, ours = holder[place], held[place], np.repeat(p[own], many)
        both = np.abs(ours - theirs) - np.abs(absent[s] - theirs) - np.abs(ours - absent[peer]) + np.abs(absent[s] - absent[peer])
        np.add.at(row, peer, both)
    return out


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (language and source) that occurs.

    Part ``pair`` has each other source of the language with the sum of differences of shares over all kept terms; part
    ``term`` the group's terms whose share is above the language's, by difference, the first ``terms`` of them.  Ties go
    by the item's UTF-8.

    Null languages, sources and texts count as empty; repeated rows count each; a group without terms has pairs only,
    a language without kept terms has pairs of value 0, a single source has none.  Texts are read whole, and counted
    before anything is shuffled.  An empty table gives an empty one; other columns, whatever their names, are ignored.

    What one task holds: the postings of a block (by hash of terms) and accumulators of ``ROWS`` groups against all of
    their language.  The groups of one language are numbered in one task: their square is the result."""
    spark = docs.sparkSession
    by_term = Window.partitionBy("lang", "term")
    met = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = met.withColumns({"docs": F.sum("d").over(by_term), "all_n": F.sum("n").over(by_term), "first": (F.row_number().over(by_term.orderBy("source")) == 1).cast("long")})
    index = written(kept.filter(F.col("docs") >= least).drop("d", "docs"), "terms")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    one_lang = Window.partitionBy("lang")
    filled = seen.join(totals, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    groups = filled.withColumns({"terms": F.sum("firsts").over(one_lang), "lang_total": F.sum("total").over(one_lang), "peers": F.count(F.lit(1)).over(one_lang), "who": (F.row_number().over(one_lang.orderBy("source")) - 1).cast("int")})
    # a language without kept terms has no shares
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups = written(groups.drop("firsts").withColumn("absent", absent), "groups")
    held = index.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    above = held.withColumn("value", F.col("p") - share(F.col("all_n"), F.col("lang_total"), F.col("terms"))).filter("value > 0")
    order = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    listed = above.withColumn("rank", F.row_number().over(order("term"))).filter(F.col("rank") <= terms)
    of_terms = listed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    peers = groups.agg(F.max("peers")).first()[0] or 0
    blocks = max(1, -(-index.count() // min(max(FEW, peers**2), MANY)))
    rows = F.expr(f"sequence(0, int((peers - 1) div {ROWS}))")
    postings = held.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.explode(rows).alias("rows"), "term", "who", "p")
    everyone = groups.withColumn("rows_", F.explode(rows)).select(F.col("lang").alias("lang_"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block_"), "rows_", F.col("who").alias("peer"), "absent")
    kind = pa.schema([("lang", pa.string()), ("who", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def accumulate(left: pa.Table, right: pa.Table) -> pa.Table:
        absent = np.empty(right.num_rows, np.int64)
        absent[right["peer"].to_numpy()] = right["absent"].to_numpy()
        term = left["term"].combine_chunks().dictionary_encode()
        codes = term.indices.to_numpy() if left.num_rows else np.empty(0, np.int64)
        first = right["rows_"][0].as_py() * ROWS
        last = min(first + ROWS, len(absent))
        sums = _accumulate(codes.astype(np.int64), left["who"].to_numpy().astype(np.int64), left["p"].to_numpy(), absent, first, last)
        lists = pa.ListArray.from_arrays(np.arange(last - first + 1, dtype=np.int32) * len(absent), sums.ravel())
        return pa.Table.from_arrays([pa.repeat(right["lang_"][0], last - first), pa.array(np.arange(first, last), pa.int32()), lists], schema=kind)

    sums = postings.groupBy("lang", "block", "rows").cogroup(everyone.groupBy("lang_", "block_", "rows_")).applyInArrow(accumulate, "lang string, who int, sums array<long>")
    cells = sums.select("lang", "who", F.posexplode("sums").alias("peer", "value")).filter("who != peer").groupBy("lang", "who", "peer").agg(F.sum("value").alias("value"))
    named = cells.join(groups.select("lang", "who", "source"), ["lang", "who"]).join(groups.select("lang", F.col("who").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    of_pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order("item")).alias("rank"))
    return of_pairs.unionByName(of_terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of each language in all ``documents``; see :func:`divergence`."""
    return divergence(table(spark, sf_dir, "documents"))


#: The same by a dense table of groups and kept terms.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM k),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
both_ AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
