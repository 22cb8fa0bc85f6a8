"""Taking personal names apart, by tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise, or_null, strip

#: What may stand behind and before a name (lower case, without periods).
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "esq", "phd", "md", "jd", "llm")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "hon", "judge", "justice", "honorable", "the")


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"[.,]", ""))


def _tokens(c: Column) -> Column:
    found = F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"[\s]+"), lambda x: F.regexp_replace(x, r"[.,]", "") != "")
    return F.transform(found, lambda x: F.regexp_replace(x, r",+$", ""))


def name_parts(c: Column) -> dict[str, Column]:
    """``first, middle, last, suffix``.  With a comma the last name comes first, without it last; suffixes and titles
    are told by their words; a single token is a first name.  Parts that are missing are null."""
    text = strip(F.coalesce(c, F.lit("")))
    comma = F.regexp_extract(text, r"^([^,]*),\s*(.*)$", 2)
    # "John Smith, Jr." has a comma before a suffix only
    only_suffix = (F.size(_tokens(comma)) > 0) & F.forall(_tokens(comma), lambda x: _bare(x).isin(*SUFFIXES))
    reversed_ = text.contains(",") & ~only_suffix
    drop = lambda tokens: F.filter(tokens, lambda x: ~_bare(x).isin(*SUFFIXES, *TITLES))
    suffix = F.array_join(F.filter(_tokens(F.when(reversed_, comma).otherwise(text)), lambda x: _bare(x).isin(*SUFFIXES)), " ")
    plain = drop(_tokens(text))
    given = F.when(reversed_, drop(_tokens(comma))).otherwise(F.when(F.size(plain) > 1, F.slice(plain, 1, F.size(plain) - 1)).otherwise(plain))
    last = F.when(reversed_, strip(F.regexp_extract(text, r"^([^,]*),", 1))).when(F.size(plain) > 1, F.element_at(plain, -1))
    clean = lambda x: F.regexp_replace(x, r",+$", "")
    middle = F.when(F.size(given) > 1, F.array_join(F.slice(given, 2, F.greatest(F.size(given) - 1, F.lit(0))), " "))
    return {"first": or_null(clean(F.get(given, F.lit(0)))), "middle": or_null(middle), "last": or_null(clean(last)), "suffix": or_null(suffix)}


def split_name(c: Column) -> dict[str, Column]:
    """``first, last, mi``: normalised parts for matching; empty where missing."""
    parts = name_parts(c)
    plain = lambda x: F.regexp_replace(normalise(x), r"[.,]", "")
    return {"first": plain(parts["first"]), "last": plain(parts["last"]), "mi": F.substring(plain(parts["middle"]), 1, 1)}


def first_then_last(c: Column) -> Column:
    """"Last, First Middle, Suffix" as "First Middle Last Suffix"; texts without a comma stay, null becomes empty.
    Suffixes keep the form they have, several are joined by commas as written."""
    text = strip(F.coalesce(c, F.lit("")))
    last, rest = F.regexp_extract(text, r"^([^,]*),\s*(.*)$", 1), F.regexp_extract(text, r"^([^,]*),\s*(.*)$", 2)
    word = "|".join(SUFFIXES)
    tail = rf"(?i)^(.*?)[\s,]*((?:\b(?:{word})\b\.?,?\s*)*)$"
    given, suffix = strip(F.regexp_extract(rest, tail, 1)), strip(F.regexp_extract(rest, tail, 2))
    return F.when(text.contains(","), F.concat_ws(" ", or_null(given), or_null(strip(last)), or_null(suffix))).otherwise(text)
