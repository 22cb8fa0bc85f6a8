"""Semi-structured text: lenient parsing, flattening, expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Pieces of a literal: an escape, a quote, or what is between.  No piece repeats a group, so a text of any length is cut up
#: in one pass.
_PIECE = r"""\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\[0-7]{1,3}|\\[\s\S]|['"]|[^\\'"]+|\\"""
#: Pieces that are written one after the other before they are put together.
_TOGETHER = 64


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _between(piece: Column) -> Column:
    """What is outside of quotes, as JSON has it: round brackets as square ones, no comma before a closing bracket, no mark
    before a quoted text, and Python's words."""
    out = F.regexp_replace(F.translate(F.regexp_replace(piece, r"\b[uU]$", ""), "()", "[]"), r",(\s*[\]}])", "$1")
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        out = F.regexp_replace(out, rf"\b{word}\b", json)
    return out


def _quoted(piece: Column) -> Column:
    """What is inside of quotes: escapes that JSON lacks are written as code points, a backslash that escapes nothing stays
    one, double quotes and tabs are escaped."""
    code = lambda digits: F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))
    rest = F.substring(piece, 2, 9)
    return (
        F.when(piece == '"', '\\"')
        .when(~piece.startswith("\\"), F.replace(piece, F.lit("\t"), F.lit("\\t")))
        .when(piece == "\\'", "'")
        .when(piece == "\\\n", "")
        .when(piece.rlike(r"^\\x.."), code(F.substring(piece, 3, 2)))
        .when(piece.rlike(r"^\\[0-7]+$"), code(F.conv(rest, 8, 16)))
        .when(piece == "\\a", "\\u0007")
        .when(piece == "\\v", "\\u000b")
        .when(piece.rlike(r'^\\(["\\bfnrt]|u.{4})$'), piece)
        .otherwise(F.concat(F.lit("\\"), piece))
    )


def from_literal(c: Column) -> Column:
    """JSON text from a Python literal of objects, lists, tuples, texts in either quotes, numbers, True, False and None.  A
    scan over pieces that knows in what quotes it is; it costs about as much as the text is long.  What is no literal comes
    out as no JSON.  A single value in round brackets counts as a list of one."""
    def cut(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _TOGETHER).cast("int")), lambda i: F.slice(pieces, i * _TOGETHER + 1, _TOGETHER))

    def step(s: Column, piece: Column) -> Column:
        outside, opens = s["mode"] == "", piece.isin("'", '"')
        closes = piece == s["mode"]
        text = F.when(outside & opens | ~outside & closes, '"').when(outside, _between(piece)).otherwise(_quoted(piece))
        mode = F.when(outside & opens, piece).when(~outside & closes, "").otherwise(s["mode"])
        return F.struct(mode.alias("mode"), F.concat(s["text"], text).alias("text"))

    def part(s: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(s["mode"].alias("mode"), F.lit("").alias("text")), step)
        return _let(done, lambda d: F.struct(d["mode"].alias("mode"), F.array_append(s["texts"], d["text"]).alias("texts")))

    start = F.struct(F.lit("").alias("mode"), F.array().cast("array<string>").alias("texts"))
    read = lambda pieces: F.aggregate(cut(pieces), start, part, lambda s: F.array_join(s["texts"], ""))
    return F.when(c != "", _let(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), read))


def lenient(c: Column) -> Column:
    """JSON text from text that may be a Python literal: as it is, as :func:`from_literal` reads it, or with all single
    quotes doubled and Python's words replaced; an empty object if none of these can be read."""
    blunt = F.replace(c, F.lit("'"), F.lit('"'))
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        blunt = F.replace(blunt, F.lit(word), F.lit(json))
    sound = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(*[_let(x, sound) for x in (c, from_literal(c), blunt)], F.lit("{}"))


def at_path(c: Column, path: str) -> Column:
    """The text at a dotted path."""
    return F.get_json_object(c, "$." + path)


def _schema(df: DataFrame, column: str) -> T.DataType | None:
    """The merged type of all readable values, from one aggregation."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT"):
        return None
    return T._parse_datatype_string(found.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace(": VOID", ": STRING"))


def _field(name: str):
    return lambda x: x.getField(name)


def flatten(df: DataFrame, column: str, most: int | None = 10, separator: str = "_", prefix: str = "") -> DataFrame:
    """``df`` with a column for each leaf of the JSON in ``column``: keys joined by ``separator``, list places as
    numbers, at most ``most`` of a list (fewer if no list is as long; with None all of the longest).  Rows that cannot be read keep their text in
    ``column`` and have null leaves; that column goes if every row could be read.

    The type is settled by one aggregation over all rows, the lengths of lists by another; then it is a projection."""
    kind = _schema(df, column)
    if kind is None:
        return df
    parsed = df.withColumn("__j", F.from_json(F.col(column), kind))
    lists: dict[str, Column] = {}

    def measure(values: Column, t: T.DataType, path: str) -> None:
        """The greatest length of each list, however deep; ``values`` has all values of a row at ``path``."""
        if isinstance(t, T.StructType):
            for f in t.fields:
                measure(F.transform(values, _field(f.name)), f.dataType, f"{path}.{f.name}")
        elif isinstance(t, T.ArrayType):
            lists[path] = F.max(F.array_max(F.transform(values, lambda x: F.size(x))))
            measure(F.flatten(F.filter(values, lambda x: x.isNotNull())), t.elementType, path + "[]")

    measure(F.array(F.col("__j")), kind, "")
    unread = F.sum((F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()).cast("long"))
    row = parsed.agg(F.coalesce(unread, F.lit(0)).alias("bad"), *[x.alias(f"n{i}") for i, x in enumerate(lists.values())]).first()
    longest = {path: max(0, row[f"n{i}"] or 0) for i, path in enumerate(lists)}
    leaves: dict[str, Column] = {}

    def walk(c: Column, t: T.DataType, name: str, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c.getField(f.name), f.dataType, f"{name}{separator}{f.name}" if name else f.name, f"{path}.{f.name}")
        elif isinstance(t, T.ArrayType):
            for i in range(longest[path] if most is None else min(most, longest[path])):
                walk(F.get(c, F.lit(i)), t.elementType, f"{name}{separator}{i}", path + "[]")
        else:
            leaves[prefix + name] = c

    walk(F.col("__j"), kind, "", "")
    taken = set(df.columns)
    out = parsed.withColumns({(f"{n}{separator}json" if n in taken else n): c for n, c in leaves.items()}).drop("__j")
    return out if row["bad"] else out.drop(column)


def expand_records(df: DataFrame, column: str, array: str, fields: dict[str, str], keep: dict[str, str], prefix: str = "") -> DataFrame:
    """One row for each element of the list at ``array`` in the JSON of ``column`` (one with nulls if there is none):
    ``fields`` of the element behind ``prefix`` and ``keep`` from around it, each a path by its new name."""
    items = F.from_json(F.get_json_object(F.col(column), f"$.{array}"), "array<string>")
    rows = df.withColumns({n: F.get_json_object(F.col(column), f"$.{p}") for n, p in keep.items()}).withColumn("__x", F.explode_outer(items))
    return rows.withColumns({prefix + n: F.get_json_object("__x", f"$.{p}") for n, p in fields.items()}).drop("__x")


def nominee_urls(df: DataFrame, column: str = "nomination") -> DataFrame:
    """``citation, nominee_url, congress, number`` for every nominee with a URL."""
    keep = {"citation": "citation", "congress": "congress", "number": "number"}
    rows = expand_records(df.select(column), column, "nominees", {"nominee_url": "url"}, keep)
    found = rows.filter(F.coalesce(F.col("nominee_url"), F.lit("")) != "")
    return found.select("citation", "nominee_url", F.col("congress").try_cast("int").alias("congress"), F.col("number").try_cast("int").alias("number"))


def nominee_records(df: DataFrame, column: str = "nomination", full: bool = True) -> DataFrame:
    """One row per nominee of each nomination with what its description says of circuit and court."""
    from .text import court_from_description

    keep = {"citation": "citation", "description": "description", "receiveddate": "receivedDate", "latestaction_text": "latestAction.text"}
    fields = {"first_name": "firstName", "last_name": "lastName", "ordinal": "ordinal", "url": "url"}
    rows = expand_records(df, column, "nominees", fields, keep, "nominee_")
    court = court_from_description(F.col("description"))
    return rows.withColumns({"is_full_detail": F.lit(full), "parsed_circuit": court["circuit"], "parsed_court": court["court"]}).drop(column)


def wide_to_long(df: DataFrame, ids: list[str], stem: str, value: str) -> DataFrame:
    """``ids, slot, value`` from columns called ``stem(1)``, ``stem(2)`` ...; nulls are left out."""
    columns = [c for c in df.columns if c.startswith(stem + "(") and c.endswith(")")]
    pairs = F.array(*[F.struct(F.lit(int(c[len(stem) + 1 : -1])).alias("slot"), F.col(f"`{c}`").alias(value)) for c in columns])
    return df.select(*ids, F.explode(pairs).alias("__x")).select(*ids, "__x.slot", f"__x.{value}").filter(F.col(value).isNotNull())
