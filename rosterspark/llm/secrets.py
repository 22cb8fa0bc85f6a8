"""Finding secrets in texts with Spark SQL functions only.

Three kinds have fixed patterns.  A fourth, ``random``, is any other token that a first order Markov model of random
strings explains better than one of ordinary words and identifiers, by the log-likelihood ratio a character.  Both
models and the ratio from which a token counts are fitted on labelled samples: values that the fixed patterns find are
random, all other tokens of the sampled documents (each different one once) are ordinary.  Random strings are also
uniform within letters of one case, digits and signs, so that kinds of keys the sample does not hold are known too.
Ordinary tokens are the same word in any case: their characters are modelled without it, and apart from them how they
are written (in one case, with a capital in front, mixed), so a word in capitals is as ordinary as its small letters.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, reserved, table

#: Kinds in their order, pattern, group whose length counts, least length.
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What must be somewhere in a text for its kind to be looked for (for hex, runs long enough are the matches).
HINTS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Codes of the characters that the models know, from ``+`` to ``z``; a code outside the alphabet never occurs.
FIRST, SIZE = 43, 80
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_.-")
ALPHABET = "".join(CLASSES)
#: Tokens of eight characters and more, with ``=`` only as padding; letters of other scripts are no borders.
CANDIDATE = r"(?<![\p{L}\p{M}\p{N}+/_.-])[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}(?![\p{L}\p{M}\p{N}])"
#: The same from two characters on: what the ordinary model learns from.
TOKEN = CANDIDATE.replace("{7,}", "{1,}")
#: How many characters the prior after each one is worth, and what every character's count is raised by.
PRIOR, RARE = 10.0, 0.5
#: How many documents a token counts for at most.
MOST = 10
#: How many different characters a random token has at least.
DISTINCT = 5
#: How much more error, in shares of each kind, any threshold may have that is as good as the best; and, where no random
#: tokens are held out, how far the threshold lies above the ordinary ones (nats a character).
AS_GOOD, MARGIN = 0.0005, 1.5
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Small letters only (or none), capitals only, one capital in front, mixed.
WRITINGS = ("small", "large", "title", "mixed")


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1, hint: str | None = None) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters: places in code
    points.  What splitting leaves between the matches and the matches themselves, in turns, make up the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("all"), value.alias("value"))
    none = F.array().cast(SPAN)

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        own = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["2"]) >= least, F.array_append(so_far["out"], own)).otherwise(so_far["out"]).alias("out"))

    named = F.transform(pairs, lambda x: F.struct(x["gap"].alias("0"), x["all"].alias("1"), x["value"].alias("2")))
    listed = F.aggregate(named, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(hint or pattern), listed).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind in ``text`` (null: none)."""
    text = F.coalesce(text, F.lit(""))
    return {name: _spans(text, pattern, n, group, least, HINTS[name]) for n, (name, pattern, group, least) in enumerate(KINDS)}


def writing(token: Column) -> Column:
    """How a token is written: its place in WRITINGS."""
    small, large = token.rlike("[a-z]"), token.rlike("[A-Z]")
    return F.when(~large, 0).when(~small, 1).when(token.rlike("^[^A-Za-z]*[A-Z][^A-Z]*$"), 2).otherwise(3)


def _bigrams(tokens: DataFrame, column: str) -> DataFrame:
    """How often each two characters of the alphabet follow each other in tokens of each writing, tokens weighed by
    ``weight``: at most the square of its size rows a writing."""
    pairs = F.expr(f"transform(sequence(1, length({column}) - 1), i -> substring({column}, i, 2))")
    cells = tokens.filter(F.length(column) > 1).select("weight", writing(F.col(column)).alias("w"), F.explode(pairs).alias("pair")).groupBy("w", "pair").agg(F.sum("weight").alias("n"))
    return cells.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_.-]{2}$"))


class Model(NamedTuple):
    """``ratios``: log-likelihood ratio of each two characters, by their codes, for tokens of one case or with a capital in
    front; ``mixed``: for all others, where an ordinary token also pays for each change of case; ``written``: what an
    ordinary token pays for each writing; ``least``: the ratio a character from which a token counts as random."""

    ratios: list[float]
    mixed: list[float]
    written: list[float]
    least: float


def _logs(counts: dict[str, float], alphabet: str = ALPHABET) -> dict[str, float]:
    """Log probability of each second character after the first: counts raised by PRIOR times how often the second one
    occurs at all, so that a character which never occurs is unlikely after any."""
    ends = {b: sum(counts.get(a + b, 0) for a in alphabet) + RARE for b in alphabet}
    all_ = sum(ends.values())
    out = {}
    for a in alphabet:
        row = [counts.get(a + b, 0) + PRIOR * ends[b] / all_ for b in alphabet]
        out.update({a + b: math.log(n / sum(row)) for b, n in zip(alphabet, row)})
    return out


def _without_case(counts: dict[tuple[int, str], float]) -> dict[str, float]:
    out: dict[str, float] = {}
    for (_, pair), n in counts.items():
        out[pair.lower()] = out.get(pair.lower(), 0.0) + n
    return out


def _case_steps(counts: dict[tuple[int, str], float]) -> dict[str, float]:
    """Log probability that a letter is large or small (U, L) after one that is, in ordinary tokens of mixed case."""
    seen = {a + b: 1.0 for a in "UL" for b in "UL"}
    for (w, pair), n in counts.items():
        if w == 3 and pair.isalpha():
            seen["".join("U" if c.isupper() else "L" for c in pair)] += n
    return {k: math.log(n / (seen[k[0] + "U"] + seen[k[0] + "L"])) for k, n in seen.items()}


def _tables(random: dict[str, float], counts: dict[tuple[int, str], float], written: dict[int, float]) -> tuple[list[float], list[float], list[float]]:
    """The two tables of ratios, and what each writing costs."""
    ordinary, steps = _logs(_without_case(counts), "".join(CLASSES[1:])), _case_steps(counts)
    plain, mixed = [0.0] * (SIZE * SIZE), [0.0] * (SIZE * SIZE)
    for pair, value in random.items():
        at = (ord(pair[0]) - FIRST) * SIZE + ord(pair[1]) - FIRST
        ratio = value - ordinary[pair.lower()]
        case = steps["".join("U" if c.isupper() else "L" for c in pair)] if pair.isalpha() else 0.0
        plain[at], mixed[at] = round(ratio, 4), round(ratio - case, 4)
    every = sum(written.values()) + len(WRITINGS)
    return plain, mixed, [round(-math.log((written.get(w, 0.0) + 1) / every), 4) for w in range(len(WRITINGS))]


def _random_logs(counts: dict[str, float]) -> dict[str, float]:
    """Half what the sample has, half uniform within the second character's class, classes following each other as the
    sample's do."""
    seen = _logs(counts)
    out = {}
    for own in CLASSES:
        steps = [sum(counts.get(a + b, 0) for a in own for b in other) + len(other) for other in CLASSES]
        for other, n in zip(CLASSES, steps):
            out.update({a + b: math.log((math.exp(seen[a + b]) + n / sum(steps) / len(other)) / 2) for a in own for b in other})
    return out


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> DataFrame:
    """``v, random, held, weight``: the different tokens of ``sample`` documents (those of least hashed id), labelled by
    the fixed patterns; a fifth, by hash, is held out of the counts.  An ordinary token
    weighs as many as documents hold it, up to MOST, but one that a single document holds only a hundredth: identifiers are
    used again, and a key that no pattern found is not to teach the model that it is ordinary."""
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    # `sample` bounds the broadcast side
    some = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), id_col, "left_semi")
    tokens = cut(some.select("t", *[v.alias(k) for k, v in base_spans(F.col("t")).items()]))
    inside = F.concat(*[F.transform(F.col(k), lambda s: F.substring("t", s["start"] + 1, s["end"] - s["start"])) for k, *_ in KINDS])
    # of an assignment, the value without keyword and sign
    values = tokens.select(F.explode(F.array_distinct(inside)).alias("v")).select(F.regexp_extract("v", r"""([A-Za-z0-9+/_.-]+)=*["']?$""", 1).alias("v"))
    plain = F.col("t")
    for _, pattern, _, _ in KINDS[:2]:
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.regexp_replace(plain, "[0-9a-f]{24,}", " ")
    ordinary = tokens.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)))).alias("v"))
    both = values.select("v", F.lit(True).alias("random")).unionByName(ordinary.select(F.regexp_replace("v", "=+$", "").alias("v"), F.lit(False).alias("random")))
    counted = both.filter(F.length("v") > 1).groupBy("v", "random").agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.select("v", "random", F.when(F.col("random"), 1.0).otherwise(F.least(F.col("n"), F.lit(MOST)) - 0.99).alias("weight"))
    return cut(weighed.withColumn("held", F.crc32(F.col("v").cast("binary")) % 5 == 0))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> Model:
    """Both models from the labelled tokens of ``sample`` documents, and the threshold that suits the tokens
    held out.  Only counts of two characters and of ratios in hundredths reach the driver."""
    tokens = sampled(docs, id_col, text_col, sample)
    of = lambda kind: {(r["w"], r["pair"]): r["n"] for r in _bigrams(tokens.filter((F.col("random") == kind) & ~F.col("held")), "v").collect()}
    keys: dict[str, float] = {}
    for (_, pair), n in of(True).items():
        keys[pair] = keys.get(pair, 0.0) + n
    plain = tokens.filter(~F.col("random") & ~F.col("held") & F.col("v").rlike("[A-Za-z]"))
    written = {r["w"]: r["n"] for r in plain.groupBy(writing(F.col("v")).alias("w")).agg(F.sum("weight").alias("n")).collect()}
    model = Model(*_tables(_random_logs(keys), of(False), written), 0.0)
    held = tokens.filter(F.col("held") & F.col("v").rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9+/_.-]{8,}$"))
    steps = held.select("random", "weight", F.ceil(likelihood_ratio(F.col("v"), model) * 100).alias("r")).groupBy("random", "r").agg(F.sum("weight").alias("n")).collect()
    return model._replace(least=threshold({(r["random"], r["r"]): float(r["n"]) for r in steps}))


def threshold(weights: dict[tuple[bool, int], float]) -> float:
    """From the weights of held-out tokens by kind and ratio (hundredths): the middle of the ratios at which the share of
    ordinary tokens above and that of random ones below are together least, or all but least.  Ordinary tokens may
    so hold some keys that no pattern found."""
    all_ = {kind: sum(w for (k, _), w in weights.items() if k == kind) or 1.0 for kind in (True, False)}
    above, below, costs = 1.0 if any(not k for k, _ in weights) else 0.0, 0.0, {}
    for r in sorted({0} | {r + 1 for _, r in weights} | {r for _, r in weights}):
        # of tokens in hundredths up to r - 1 the ratio lies below r
        above -= weights.get((False, r - 1), 0.0) / all_[False]
        below += weights.get((True, r - 1), 0.0) / all_[True]
        costs[r] = above + below
    good = [r for r, cost in costs.items() if r >= 0 and cost <= min(costs.values()) + AS_GOOD]
    if not any(kind for kind, _ in weights):
        return good[0] / 100 + MARGIN
    return (good[0] + good[-1]) / 200


def likelihood_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood ratio of the token's neighbouring characters, and of how it is written, a character; trailing ``=``
    is no part of it."""
    bare = F.rtrim(token, F.lit("="))
    code = lambda i: F.ascii(F.substring(bare, i, F.lit(1))) - FIRST
    steps = F.sequence(F.lit(1), F.length(bare) - 1)
    listed = lambda values: F.from_json(F.lit(json.dumps(values)), "array<double>")
    total = lambda values: F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.get(listed(values), code(i) * SIZE + code(i + 1)))
    way = writing(bare)
    sums = F.when(way == 3, total(model.mixed)).otherwise(total(model.ratios))
    return (sums + F.get(listed(model.written), way)) / (F.length(bare) - 1)


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with array columns ``assign, access, hex`` and ``random`` (behind ``prefix``) of spans (start, kind,
    end; end exclusive, code points).  Null and empty texts have none, texts of any length are scanned whole; columns
    of these names are replaced.

    A random token counts unless it lies within a span of a fixed kind; one that reaches beyond it is a span of its
    own, so no rest of a longer key stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names, random = [prefix + k for k, *_ in KINDS], prefix + "random"
    base = reserved(docs, *names, random).withColumns({prefix + k: c for k, c in base_spans(text).items()})
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    # numbers, and few characters that repeat, as in a ruler, are no keys
    many = lambda t: t.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(t, ""))) >= DISTINCT)
    seen = base.withColumn(random, F.filter(tokens, lambda t: (likelihood_ratio(t, model) >= model.least) & many(t)))

    def new(s: Column) -> Column:
        within = [F.exists(F.col(name), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])) for name in names]
        return F.array_contains(F.col(random), F.substring(text, s["start"] + 1, s["end"] - s["start"])) & ~(within[0] | within[1] | within[2])

    found = F.when(F.size(random) > 0, F.filter(_spans(text, CANDIDATE, len(KINDS)), new)).otherwise(F.array().cast(SPAN))
    return seen.withColumn(random, found)


def _listed(spans: Column) -> Column:
    """``kind:start:end``, by start and then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("random"))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> DataFrame:
    """Per row: id, how many spans of each fixed kind, digest of these, and all spans.

    Every row counts, repeated ones too; null texts have no spans; spans that start at one place are listed by kind; an
    empty table gives an empty one; other columns, whatever their names, are ignored."""
    found = with_spans(docs.select(id_col, text_col), train(docs, id_col, text_col, sample), text_col, prefix="__")
    base = F.concat("__assign", "__access", "__hex")
    return found.select(
        id_col,
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, F.col("__random"))).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", sample: int = 2000) -> DataFrame:
    """``docs`` with every span in the text replaced by ``mark`` (overlapping spans by one) and, where there is such a
    column, ``n_chars`` of the new text.  No row goes."""
    row, spans = F.struct(*docs.columns), ["__assign", "__access", "__hex", "__random"]
    held = docs.select(row.alias("__row"), F.col(text_col).alias("__t"))  # so that no column's name can clash
    found = with_spans(held, train(docs, id_col, text_col, sample), "__t", prefix="__")
    every = F.array_sort(F.concat(*spans))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(F.col("__t"), s["at"] + 1, x["start"] - s["at"])
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], before, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col("__t"), s["at"] + 1, F.length("__t")))
    some = F.size(every) > 0
    changed = {text_col: F.when(some, F.aggregate(every, start, step, rest)).otherwise(F.col("__t"))}
    out = found.withColumn("__clean", changed[text_col])
    if "n_chars" in docs.columns and text_col != "n_chars":
        changed["n_chars"] = F.when(some, F.length("__clean")).otherwise(F.col("__row.n_chars")).cast(docs.schema["n_chars"].dataType)
    changed[text_col] = F.col("__clean")
    return out.select(*[changed.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; see :func:`find_secrets`."""
    return find_secrets(table(spark, sf_dir, "documents"))
