"""Main text of web pages by consensus within hosts.

Pages of a host are made from few templates, so where one page leaves doubt the others settle it.  Every page scores
its containers by the text they hold; scores go by the container's generalised path of tags and classes (digits count
as one sign) and are summed for each host in Spark.  The path that wins a host says what is extracted from its pages;
a page without such a container falls back on its own best path.

What is marked as no part of an article goes before any score, unless it holds the page: a form around everything, or
a class such as ``content search``, is no reason to lose an article.  A page takes time in proportion to its length,
however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, table

#: Elements whose content is never text (the second row may be empty, ``<svg/>``), that are no part of an
#: article, that hold others, that end a block, that a head may hold.
RAW = "script|style|noscript|template|textarea|title|xmp|noembed|noframes"
RAW_OR_EMPTY = "iframe|svg|math|object|canvas|audio|video|select"
IN_HEAD = frozenset("base link meta head html".split())
ASIDE = frozenset("nav header footer aside form button menu dialog head label input".split())
HOLDERS = frozenset("body main article section div td center blockquote details".split())
BLOCKS = HOLDERS | ASIDE | frozenset("html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre figure figcaption address fieldset hr summary hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id or role that mark what is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies widget toolbar pagination pager login search copyright hidden".split()
)
BEARERS = frozenset("content post entry article story text main body".split())
#: Beside one of these a mark says what the page has or lacks, not what the container is.
MODIFIERS = frozenset("has no with without is not enabled disabled xs sm md lg".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
#: Kinds of elements: kept, kept but for its headings only, dropped, and dropped unless it holds this share of the text.
KEPT, HEADINGS_ONLY, DROPPED = 0, 1, 2
UNLESS = {3: 0.9, 4: 0.3, 5: 0.5}
MARKED, MARKED_BEARER, FORM = UNLESS
#: A container within this many others counts as the one around it.
DEEP = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{RAW_OR_EMPTY})\b(?:[^>\"'/]++|\"[^\"]*\"|'[^']*'|/(?!>))*+/>"
    rf"|<(?P<raw>{RAW}|{RAW_OR_EMPTY})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}


def _kind(tag: str, found: dict[str, str], in_article: bool) -> int:
    """What becomes of an element, by its tag and attributes."""
    if tag == "form":
        return FORM
    if tag in ASIDE:
        return HEADINGS_ONLY if tag == "header" and in_article else DROPPED
    if not found or tag in ("html", "body", "main"):
        return KEPT
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return MARKED
    marked = bearer = False
    for name in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split():
        words = set(_WORD.findall(name))
        marks = words & (COMMENTS if tag == "article" else MARKS) or "header" in words and tag != "article" and not words & BEARERS
        marked = marked or bool(marks) and not words & MODIFIERS
        bearer = bearer or not marks and bool(words & BEARERS)
    return KEPT if not marked else MARKED_BEARER if bearer else MARKED


class Page:
    """A page's text blocks in order, the elements around them, and the paths of its containers.

    ``texts``, ``linked`` (characters in links), ``within`` (number of the innermost element) and ``heading`` go by
    block; ``parent``, ``path`` and ``kind`` by element, ``paths`` and ``above`` (the path around) by path; what is
    around something has the lower number, and number 0 is the page."""

    def __init__(self, html: str | None):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.within: list[int] = []
        self.heading: list[bool] = []
        self.parent, self.path, self.kind = [0], [0], [KEPT]
        self.paths, self.above, self._depth = [""], [0], [0]
        self._numbers: dict[tuple[int, str], int] = {}
        self._read(html or "")
        self._settle()

    def _into(self, at: int, part: str) -> int:
        """The number of the path one ``part`` below path ``at``."""
        if self._depth[at] >= DEEP:
            return at
        number = self._numbers.setdefault((at, part), len(self.paths))
        if number == len(self.paths):
            self.paths.append(f"{self.paths[at]}/{part}")
            self.above.append(at)
            self._depth.append(self._depth[at] + 1)
        return number

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_: dict[str, int] = {}
        parts: list[str] = []
        linked, in_link, heading, at = 0, False, False, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.texts.append(text)
                    self.linked.append(min(linked, len(text)))
                    self.within.append(stack[-1][1])
                    self.heading.append(heading)
                parts.clear()
            linked = 0

        def take(raw: str) -> None:
            nonlocal linked
            if raw:
                text = unescape(raw) if "&" in raw else raw
                parts.append(text)
                if in_link:
                    linked += len(text)

        def close(tag: str) -> None:
            if open_.get(tag):
                flush()
                name = None
                while name != tag:
                    name = stack.pop()[0]
                    open_[name] -= 1

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                take(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                take(" ")
                continue
            if tag == "a":
                in_link = not m["end"]
                continue
            block = tag in BLOCKS
            if block:
                flush()
                in_link = False
            if m["end"]:
                if tag in HEADINGS:
                    heading = False
                close(tag)
                continue
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                close("head")  # its end tag may be left out
            if tag in VOID:
                continue
            if tag in HEADINGS:
                heading = True
            elif tag in HOLDERS or tag == "p" or tag == "li":
                heading = False
            found = _attributes(m["rest"])
            kind = _kind(tag, found, bool(open_.get("article") or open_.get("main")))
            if tag in HOLDERS or kind != KEPT:
                if kind != KEPT and not block:
                    flush()
                around = stack[-1][1]
                path = self.path[around]
                if tag in HOLDERS:
                    classes = ".".join(sorted(re.sub(r"\d+", "#", found.get("class", "").lower()).split()))
                    path = self._into(path, tag + (f".{classes}" if classes else ""))
                stack.append((tag, len(self.parent)))
                open_[tag] = open_.get(tag, 0) + 1
                self.parent.append(around)
                self.path.append(path)
                self.kind.append(kind)
        take(html[at:])
        flush()

    def _settle(self) -> None:
        """Drops the blocks that are no part of an article."""
        sure = [False] * len(self.parent)  # within what goes in any case
        only = [False] * len(self.parent)  # within what keeps its headings only
        for e in range(1, len(self.parent)):
            sure[e] = sure[self.parent[e]] or self.kind[e] == DROPPED
            only[e] = only[self.parent[e]] or self.kind[e] == HEADINGS_ONLY
        kept = [not sure[e] and (h or not only[e]) for e, h in zip(self.within, self.heading)]
        held = [0] * len(self.parent)
        for e, text, stays in zip(self.within, self.texts, kept):
            held[e] += len(text) if stays else 0
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        gone = [False] * len(self.parent)
        for e in range(1, len(gone)):
            gone[e] = gone[self.parent[e]] or self.kind[e] in UNLESS and held[e] < UNLESS[self.kind[e]] * held[0]
        stay = [n for n, e in enumerate(self.within) if kept[n] and not gone[e]]
        for name in ("texts", "linked", "within", "heading"):
            setattr(self, name, [getattr(self, name)[n] for n in stay])

    def scores(self) -> dict[str, int]:
        """Score of each container path: characters of text, links taken off twice, times the path's leaning.  Text
        without a container counts for the path of the whole page."""
        sums = [0] * len(self.paths)
        some = [False] * len(self.paths)
        for text, linked, e in zip(self.texts, self.linked, self.within):
            sums[self.path[e]] += len(text) - 2 * linked
            some[self.path[e]] = True
        for n in range(len(sums) - 1, 0, -1):
            sums[self.above[n]] += sums[n]
            some[self.above[n]] |= some[n]
        return {p: n * (_leaning(p) if p else 60) for p, n, is_there in zip(self.paths, sums, some) if is_there}

    def under(self, path: str) -> list[str]:
        """The blocks within the containers of ``path``."""
        inside = [p == path for p in self.paths]
        for n in range(1, len(inside)):
            inside[n] = inside[n] or inside[self.above[n]]
        return [t for t, e in zip(self.texts, self.within) if inside[self.path[e]]]


def _leaning(path: str) -> int:
    """Hundredths by which a container's text counts, by what its last tag and classes say."""
    tag, _, kinds = path.rsplit("/", 1)[-1].partition(".")
    if tag == "article":
        return 160
    if tag == "main":
        return 140
    if tag == "body":
        return 70
    return 130 if BEARERS & set(_WORD.findall(kinds)) else 100


def best(of: dict[str, int]) -> str | None:
    """The path of the greatest score; of equal ones the longer, then the greater."""
    return max(of, key=lambda p: (of[p], len(p), p)) if of else None


def main_text(html: str | None, path: str | None) -> str:
    """The text under ``path``, or under the page's own best path if it has none there."""
    page = Page(html)
    found = page.under(path) if path is not None else []
    if not found and page.texts:
        found = page.under(best(page.scores()))
    return " ".join(found)


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: the container path with the greatest sum of scores over the host's pages."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.LongType())])
    types = to_arrow_schema(schema)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, n in Page(html).scores().items():
                    sums[host, path] = sums.get((host, path), 0) + n
            rows = [(h, p, n) for (h, p), n in sums.items()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types)], schema.names)

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, schema)
    summed = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max(F.struct("score", F.length("path").alias("n"), "path")).alias("won")).select("host", F.col("won.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = 20_000) -> DataFrame:
    """Per row: id, url, ``text`` (empty where there is none) and ``n_chars``.

    Null and empty pages give empty texts; a null url counts as a host without name; repeated rows give repeated rows;
    pages of any length are read whole; of equal scores the longer path wins, then the greater; an empty table gives
    an empty one; further columns, whatever their names, are ignored.  Winning paths are sent to all executors when they are at most ``small`` hosts, and
    joined by host (a hot host split by adaptive execution) when more."""
    won = cut(winning_paths(pages, url_col, html_col))
    few = won.count() <= small
    plain = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = plain.join(F.broadcast(won) if few else won, "host", "left")
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("u", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            columns = [batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = joined.select("i", "u", "html", "path").mapInArrow(apply, schema)
    return out.withColumnsRenamed({"i": id_col, "u": url_col})


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; see :func:`extract`."""
    return extract(table(spark, sf_dir, "pages"))
