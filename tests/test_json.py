"""Lenient JSON against Python's own reading of literals."""

from __future__ import annotations

import ast
import json
import random
import time

from pyspark.sql import functions as F

from rosterspark.functions import jsonx


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["j"] for r in df.select("i", jsonx.lenient(F.col("t")).alias("j")).collect()}
    return [json.loads(got[i]) for i in range(len(texts))]


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def value(rnd, depth=0):
    kind = rnd.randint(0, 5 if depth > 3 else 8)
    if kind < 4:
        return "".join(rnd.choices(["'", '"', "\\", "\n", "\t", "\x07", "a", "é", "日", "None", ", ", "}", "[", "(", ":", "\x7f", "𝄞", "\\n", "u"], k=rnd.randint(0, 8)))
    if kind < 6:
        return rnd.choice([None, True, False, 0, -17, 2.5, 1e30])
    if kind == 6:
        return {value(rnd, 9) if rnd.random() < 0 else f"k{i}'\"": value(rnd, depth + 1) for i in range(rnd.randint(0, 3))}
    # a tuple of one is written with a comma
    return rnd.choice([list, tuple])([value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))])


def test_what_python_writes_is_read(spark):
    rnd = random.Random(17)
    values = [{"a": value(rnd), "b": value(rnd)} for _ in range(400)]
    assert read(spark, [repr(v) for v in values]) == [plain(v) for v in values]


def test_literals_by_hand(spark):
    texts = [
        """{'a': 'say "hi"'}""",
        r"""{'a': 'it\'s'}""",
        "{'a': (1, 2)}",
        "{'a': ((), (1,), [ ], {'b': ('x', None)}, ), }",
        r"""{'a': "dou\"ble ' 'None'", "b": '\x41\102é\a\v\q\/\\'}""",
        "{u'a': u'x', 'menu': 'u'}",
        "{'a': 'one\\\ntwo'}",
        "{'True': True, 'x': 'True, False', 'y': [None]}",
    ]
    assert read(spark, texts) == [plain(ast.literal_eval(t)) for t in texts]


def test_other_texts(spark):
    assert read(spark, ['{"a": 1}', "{'a': true, 'b': null}", "{'a\": \"b'}", '{"a": True}']) == [{"a": 1}, {"a": True, "b": None}, {"a": "b"}, {"a": True}]
    assert read(spark, [None, "", "no", "{'a': ", "'", "\\", "{'a': 'b}", "{'a' 1}"]) == [{}] * 8


def test_long_texts_take_time_by_their_length(spark):
    made = [repr({"a": ["it's", 'say "x"', "\\", "plain"] * n}) for n in (10, 8000)]
    began = time.time()
    assert read(spark, made) == [ast.literal_eval(t) for t in made]
    assert time.time() - began < 30 and len(made[1]) > 200_000
