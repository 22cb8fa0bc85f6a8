"""Text expressions: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import JUDICIAL_TOKENS, PARTIES, STATES, lookup

#: Accented letters and what stands for them.
ACCENTS, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


def strip(c: Column) -> Column:
    """Without ASCII white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def or_null(c: Column) -> Column:
    """Null instead of an empty text."""
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or where it is empty."""
    return or_null(F.regexp_extract(c, pattern, group))


def normalise(c: Column) -> Column:
    """Plain letters, lower case, stripped; null becomes empty."""
    return F.coalesce(strip(F.lower(F.translate(c.cast("string"), ACCENTS, PLAIN))), F.lit(""))


#: Parts of the names of columns that hold keywords.
KEYWORD_COLUMNS = ("court", "circuit", "district", "description", "name", "degree", "school")


def normalise_keyword_columns(df: DataFrame) -> DataFrame:
    """Normalises string columns whose name has one of KEYWORD_COLUMNS in it."""
    kinds = dict(df.dtypes)
    chosen = [c for c in df.columns if kinds[c] == "string" and any(k in c.lower() for k in KEYWORD_COLUMNS)]
    return df.withColumns({c: normalise(F.col(f"`{c}`")) for c in chosen})


def clean_name(c: Column) -> Column:
    """Lower case, no periods or commas, single blanks; null becomes empty."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,]", ""), r"\s+", " ")), F.lit(""))


def full_name(*parts: Column) -> Column:
    """The parts that are there, joined by blanks."""
    return F.concat_ws(" ", *[or_null(strip(p.cast("string"))) for p in parts])


#: What a description says of position, court and state.
POSITION = r"to be (?:a |an )?(.*?)(?: for| of| to)(?: the)? (.*?)(?:,|\.|\s+vice)"
STATE = r"of (.*?)(?:,|\.|\s+to be)"


def court_and_position(description: Column) -> dict[str, Column]:
    """``extracted_position, extracted_court, extracted_state``; empty where nothing is found."""
    of = lambda p, g: F.coalesce(strip(F.regexp_extract(description, p, g)), F.lit(""))
    return {"extracted_position": of(POSITION, 1), "extracted_court": of(POSITION, 2), "extracted_state": of(STATE, 1)}


#: Votes in a latest action (lower case).
YEA_NAY = r"yea[-\s]*nay vote\.?\s*(\d+)\s*-\s*(\d+)"
YEA_ONLY = r"yea[-\s]*nay vote\.?\s*(\d+)(?!\s*-\s*\d+)"
BULLET = r"^\s*-\s*(\d+)\."
RECORD = r"record vote number:\s*(\d+)"


def latest_action(action: Column) -> dict[str, Column]:
    """What was done, by what votes; an unknown action is null, without votes, neither by voice nor unanimous."""
    t = F.lower(action)
    number = lambda p, g=1: F.regexp_extract(t, p, g).try_cast("int")
    both = t.rlike(YEA_NAY)
    yea = F.when(both, number(YEA_NAY)).otherwise(F.coalesce(number(YEA_ONLY), number(BULLET)))
    nay = F.when(both, number(YEA_NAY, 2))
    kind = F.when(t.contains("confirmed"), "confirmed").when(t.contains("withdraw"), "withdrawn").when(t.contains("returned"), "returned")
    unanimous = t.contains("unanimous") | (yea >= 100) | ((yea > 0) & (nay == 0))
    return {
        "latest_action_taken": kind.when(t.isNotNull(), "other"),
        "yea_votes": yea,
        "nay_votes": nay,
        "record_vote_number": number(RECORD),
        "was_voice_vote": F.coalesce(t.contains("voice vote"), F.lit(False)),
        "was_unanimous_decision": F.coalesce(unanimous, F.lit(False)),
    }


#: The comma before a reason, and stems of reasons.
REASON = r"(?i)\s*,\s*(retir|elevat|deceas|withdraw|no senate vote|reject|resign)"
#: What a stem is called (any other by itself), and what is after "vice".
REASONS = {"retir": "Retirement", "elevat": "Elevated", "deceas": "Death", "resign": "Resignation", "withdraw": "Withdrawal", "reject": "Rejection"}
AFTER_VICE = r"(?i)\bvice\s+([^,.]+?)(?=[,.]|$)"
#: Words before a predecessor's name.
BEFORE_NAME = ("vice", "succeeding")


def predecessor(description: Column) -> Column:
    """What follows the word "vice", up to a comma and a reason; null if nothing does.  A suffix keeps its period."""
    after = F.regexp_extract(description, r"(?is)\bvice\b\s*(.*)$", 1)
    rest = F.regexp_replace(F.element_at(F.split(after, REASON, 2), 1), r"^[ ,.]+", "")
    suffix = r"(?i)(\b(?:jr|sr|iii|ii|iv)\.)[ ,.]*$"
    name = F.when(rest.rlike(suffix), F.regexp_replace(rest, suffix, "$1")).otherwise(F.regexp_replace(rest, r"[ ,.]+$", ""))
    position = F.regexp_replace(strip(F.regexp_replace(F.lower(name), r"p\.\s*l\.?", "public law")), r"\s+", " ")
    return or_null(F.when(F.lower(name).startswith("a new position"), position).otherwise(name))


def vacancy_reason(description: Column) -> Column:
    """Why the seat is empty; null without "vice" and a reason."""
    who = F.lower(F.regexp_extract(description, AFTER_VICE, 1))
    stem = F.lower(F.regexp_extract(description, REASON, 1))
    named = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), lambda k, v: k == stem)), F.lit(0))
    of = F.coalesce(named, F.when(stem != "", F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 100))))
    return F.when(who.contains("new position"), "New Position").when(who != "", of)


def crosswalk_predecessor(description: Column) -> Column:
    """The name after "vice", else after "succeeding", up to a period or comma."""
    return F.coalesce(*[or_null(strip(F.regexp_extract(description, rf"(?i){w}\s+([^.,]+)", 1))) for w in BEFORE_NAME])


def fill_from(target: Column, found: Column, blank_too: bool = True) -> Column:
    """``found`` where ``target`` is null (or blank)."""
    return F.coalesce(F.when(strip(target) != "", target) if blank_too else target, found)


#: Court, date and reason of a nomination that failed.
OTHER = r"^(?:Nominated to|Received recess appointment to)\s+(.*?),\s+([A-Z][a-z]+\s\d{1,2},\s\d{4});\s+(.+)$"


def other_nomination(c: Column) -> dict[str, Column]:
    t = strip(c)
    return {
        "court_name_other": extract(t, OTHER, 1),
        "other_nom_date": F.try_to_timestamp(extract(t, OTHER, 2), F.lit("MMMM d, yyyy")).cast("date"),
        "other_nom_failure_reason": or_null(F.lower(strip(F.regexp_extract(t, OTHER, 3)))),
    }


def court_from_description(description: Column) -> dict[str, Column]:
    """``circuit`` as two digits, and ``court``: first letter of the direction and the state's code."""
    circuit = extract(description, r"(?i)(\d+)(?:st|nd|rd|th)?\s+Circuit")
    state = strip(F.regexp_extract(description, r"(?i)District\s+of\s+([A-Za-z\s]+)", 1))
    direction = F.upper(F.substring(F.regexp_extract(description, r"(?i)\b(Northern|Southern|Eastern|Western|Central|Middle)\b", 1), 1, 1))
    return {"circuit": F.when(F.length(circuit) < 2, F.lpad(circuit, 2, "0")).otherwise(circuit), "court": F.concat(direction, F.try_element_at(lookup(STATES), state))}


#: Courts without a circuit, and circuits that have no number.
SPECIAL_COURTS = ("IT", "CL", "SC", "FED", "DC")
CIRCUIT_NUMBERS = {"DC": "12", "FD": "13", "FED": "13", "IT": "13", "CL": "13", "SC": "13"}


def circuit_court(c: Column) -> dict[str, Column]:
    """``circuit`` (1 to 13 or null), ``court``, ``is_valid``.  Text that is no court code stays as the court."""
    t = strip(c)
    special = extract(t, rf"^({'|'.join(SPECIAL_COURTS)})(?: -.*)?$")
    left, right = strip(F.regexp_extract(t, r"(?s)^(.*?) - (.*)$", 1)), strip(F.regexp_extract(t, r"(?s)^(.*?) - (.*)$", 2))
    split = t.contains(" - ")
    number = F.coalesce(F.try_element_at(lookup(CIRCUIT_NUMBERS), left), left).try_cast("int")
    sound = split & number.between(1, 13)
    loose = F.when(split & right.isin(*SPECIAL_COURTS), right)
    return {
        "circuit": F.when(special.isNull() & sound, number),
        "court": F.coalesce(special, F.when(sound, right), loose, c),
        "is_valid": F.coalesce(special.isNotNull() | sound | loose.isNotNull(), F.lit(False)),
    }


def valid_court(c: Column) -> Column:
    """Whether the text is like a court's identifier."""
    t = strip(c)
    ways = r"^(?:\d+\s*-\s*[A-Za-z]+|[A-Za-z]+\s*-\s*[A-Za-z]+|IT$|CL$|SC$|[A-Za-z\s]+(?i:Circuit|Court|District))"
    return F.coalesce(t.rlike(ways), F.lit(False))


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


#: Degrees and their levels, in this order.
DEGREES = (
    (r"(s\.?j\.?d\.?|j\.?s\.?d\.?|ph\.?d\.?)", 6),
    (r"(ll\.?m\.?)", 5),
    (r"(j\.?d\.?|doctor of jurisprudence|juris doctor)", 5),
    (r"(ll\.?b\.?)", 5),
    (r"(m\.?d\.?)", 5),
    (r"(m\.?(a|s|b|p)\.?)", 3),
    (r"(b\.?(a|s)\.?)", 2),
    (r"(a\.?(a|s)\.?)", 1),
)


def degree_level(c: Column) -> Column:
    out = None
    for pattern, level in DEGREES:
        found = c.rlike(f"(?i){pattern}")
        out = F.when(found, level) if out is None else out.when(found, level)
    return out


def seat_level(title: Column) -> Column:
    """supreme, circuit or district, else other."""
    found = F.regexp_extract(F.lower(title), r"(supreme|circuit|district|(?<=\s)tax|international|appeals)", 1)
    return F.when(found.isin("supreme", "circuit", "district"), found).otherwise("other")


def party_code(c: Column) -> Column:
    """Codes for known spellings; others stay."""
    return F.coalesce(F.try_element_at(lookup(PARTIES), F.lower(strip(c))), c)


def unmapped_parties(df: DataFrame, column: str) -> DataFrame:
    """Values that :func:`party_code` does not know, and how often they occur."""
    known = F.lower(strip(F.col(column))).isin(*PARTIES, *map(str.lower, PARTIES.values()))
    return df.filter(F.col(column).isNotNull() & ~known).groupBy(column).count()


def term_years(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("fifteen"), 15).when(t.contains("five"), 5)


def seat_key(circuit: Column, court: Column, incumbent: Column, vacancy: Column) -> Column:
    who = F.coalesce(or_null(strip(incumbent)), F.lit("POSITION OPEN"))
    return F.lower(F.concat(F.coalesce(circuit.cast("string"), F.lit("")), F.lit("-"), F.coalesce(court, F.lit("")), F.lit("|"), who, F.lit("|"), F.coalesce(F.date_format(vacancy, "yyyy-MM-dd"), F.lit(""))))


def likely_judicial(description: Column) -> Column:
    return F.lower(F.coalesce(description, F.lit(""))).rlike("|".join(JUDICIAL_TOKENS))
