"""Literals and JSON of any depth against Python's own."""

import ast
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import difference
from foretally.functions import literals as L
from foretally.functions import text as T
from foretally.plans import texts


def run(spark, expr, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(2)
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def value(r, depth, strings):
    kind = r.random()
    if depth and kind < 0.45:
        n = r.randint(0, 3)
        if kind < 0.2:
            return [value(r, depth - 1, strings) for _ in range(n)]
        if kind < 0.27 and n > 1:
            return tuple(value(r, depth - 1, strings) for _ in range(n))
        return {r.choice(STRINGS) + str(k): value(r, depth - 1, strings) for k in range(n)}
    return r.choice([r.randint(-999, 10**20), round(r.uniform(-5, 5), 3), r.uniform(0, 1) * 10.0 ** r.randint(-9, 25), True, False, None, r.choice(strings)])


STRINGS = ["a", "it's", 'say "x"', "]", "[1, 2", "}", "{'a': 1}", "a,b: c", "back\\slash", "new\nline", "tab\t", "éü", "\U0001f600", "", "12", "true", "1.50", "\x7f", "end\\'"]


def reference(text):
    """The shortest suffix up to the last bracket that Python reads as a literal."""
    end = text.rfind("]")
    start = text.rfind("[", 0, end) if end >= 0 else -1
    while start != -1:
        try:
            ast.literal_eval(text[start : end + 1])
            return text[start : end + 1]
        except (ValueError, SyntaxError, MemoryError):
            start = text.rfind("[", 0, start)
    return ""


def test_last_literal_of_any_depth(spark):
    r = random.Random(1)
    texts = [
        "[1, 2.5]", "a [1,[2,[3,[4,[5]]]]] b", "it's [1, 'x[2']", "[1,]", "[,]", "[1 2]", "[]", "text [1,2] more [3]", "x", "", "['a]b', {'k': (1,2), 'z': [1]}, {1,2}]", "[{1:2,3}]", "[{1,2:3}]", "[{1:2:3}]", "[{,}]", "[(1,)]", "[(,)]", "['it\\'s', \"q\"] ", "[1][2]", "a]", "[a]", "[1)]", "[(1])",
        "[-1e-5, +.5, None, 1_000, 0x1f]", "x = ['can\\'t [stop', 3]", "['a' 1]", "[1:2]", "[1, 'open]", "[1]\n]", "['two\\\\', [3]]", "[[[]], ()]", "[{}]", "[1,,2]", "['\n']",
    ]
    for _ in range(250):
        v = repr([value(r, 5, STRINGS) for _ in range(r.randint(0, 3))])
        texts.append(r.choice(["", "out: ", "it's ", "[3] then ", "('x', "]) + v + r.choice(["", " end", ")", "\n\n", " }"]))
        cut = r.randint(0, len(v))
        texts.append(v[:cut] + r.choice(["]", ")", ",", "'", "[1]"]) + v[cut:])
    got = run(spark, L.last_list_literal(F.col("x")), texts)
    for x, g in zip(texts, got, strict=True):
        want = reference(x)
        # adjacent strings, which Python joins, are no literal here
        if g["text"] != want:
            assert g["text"] == "" and ("'" in want or '"' in want), (x, g, want)
        elif want:
            assert g["deep"] == any(isinstance(v, (list, tuple, dict, set)) for v in ast.literal_eval(want)), x
    assert sum(g["text"] == reference(x) for x, g in zip(texts, got, strict=True)) > 0.97 * len(texts)
    assert run(spark, L.last_list_literal(F.col("x")), [None])[0]["text"] == ""


def test_lists_of_numbers(spark):
    texts = ["[[[[[1]]]]] [1.5, np.float64(2)]", "[[[[[1]]]]]", "['a[', 1]", "no", "[1, 2,]"]
    assert run(spark, T.last_list(F.col("x")), texts) == [[1.5, 2.0], None, None, None, [1.0, 2.0]]
    assert run(spark, T.list_problem(F.col("x")), texts) == [None, "forecast list is not flat", "forecast list has an item that is no number", "no Python forecast list found", None]


def test_python_to_json(spark):
    r = random.Random(2)
    lists = lambda v: [lists(x) for x in v] if isinstance(v, (list, tuple)) else {k: lists(x) for k, x in v.items()} if isinstance(v, dict) else v
    values = [{k: value(r, 4, STRINGS) for k in ("order", "it's", 'q"', "n")} for _ in range(200)] + [{"a": [1, [2, [3, [4, [5, {"b": ("x",)}]]]]]}, {1: 2, True: None, None: (1, 2), 1.5: {}}]
    want = [json.dumps(lists(v), ensure_ascii=False) for v in values]
    got = run(spark, L.python_to_json(F.col("x")), [repr(v) for v in values])
    for v, g, w in zip(values, got, want, strict=True):
        assert json.loads(g) == json.loads(w), v
    # before version 19 Java may write a digit more than it needs
    assert [json.dumps(json.loads(g), ensure_ascii=False) for g in got] == want and sum(g == w for g, w in zip(got, want, strict=True)) > 180
    odd = ["{'a': {1, 2}}", "{'a': f(1)}", "{(1, 2): 3}", " not a dict ", "{'a': 0x10}", "{'a': 1", ""]
    assert run(spark, L.python_to_json(F.col("x")), odd) == [x.strip() for x in odd]
    assert run(spark, L.python_to_json(F.col("x")), ["{'a': (1, 2,), \"b\": [True,], }", "{ 'x' : 1_000 , 'y':.5, 'z': 1.}"]) == ['{"a": [1, 2], "b": [true]}', '{"x": 1000, "y": 0.5, "z": 1.0}']


def test_canonical_json(spark):
    r = random.Random(3)
    rounded = lambda v: {k: rounded(x) for k, x in v.items()} if isinstance(v, dict) else [rounded(x) for x in v] if isinstance(v, list) else round(v, 4) if isinstance(v, float) else v
    listed = lambda v: json.loads(json.dumps(v))
    values = [listed(value(r, 6, STRINGS + ["x", "1.5"])) for _ in range(300)] + [{"b": {"d": {"f": {"h": {"j": [1.00001, {"z": 1, "a": "12"}]}}}}, "a": "1.123456"}, [], {"n": "null"}, [[[[[[1.23456]]]]]]]
    values = [v for v in values if v != {} and v is not None]
    texts = [json.dumps(v, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5) for v in values]
    for t, g in zip(texts, run(spark, T.canonical_json(F.col("x")), texts), strict=True):
        want = json.dumps(rounded(json.loads(t)), sort_keys=True)
        assert g == want or re.search(r"e[+]\d\d", want) and json.dumps(json.loads(g)) == want, t
    odd = ["not json", "{'a': 1}", '{"a": 1', '{1: 2}', '{"a": 01}', " {} ", "null", "", None]
    assert run(spark, T.canonical_json(F.col("x")), odd) == ["not json", "{'a': 1}", '{"a": 1', '{1: 2}', '{"a": 01}', "{}", "{}", "{}", "{}"]


@pytest.mark.parametrize("x", [1.0, 0.0001, 12345678.5, 1e-5, 1.5e-7, 1e16, -0.0, 123456789012345.6, 0.1, -2.5, 3e100])
def test_floats_as_python_writes_them(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(L.python_float(F.col("x"))).first()[0] == repr(x)


@pytest.mark.parametrize("name", ["last_literals", "list_literals", "list_explode"])
def test_halves_of_floats_round_as_in_sql(spark, tmp_path, name):
    """0.0135 as a float is less than it says, but a thousand times that is 13.5 in floats."""
    rows = [(i, [k / 10_000 for k in (i * 37 - 900, 135 + 10 * i, 5 - 20 * i, 7 * i)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert difference(spark, texts.QUERIES[name], texts.SQL[name], sf=str(tmp_path)) is None
