import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.errors import ConversionError
from tessella.functions import repair as R
from tessella.functions.extract import balanced, extract_json, loads, strict
from tessella.plans.validator import validate

GOOD = [
    ('{"probe": "P-11", "depth": 412}', {"probe": "P-11", "depth": 412}), ('```json\n{"valve": null, "open": [true, false]}\n```', {"valve": None, "open": [True, False]}),
    ('Reading of 04:10 was {"salt": 3.5e1, "unit": "g/l"}, so the pump went on.', {"salt": 35.0, "unit": "g/l"}), ('[{"lane": 1}, {"lane": 2}, []]', [{"lane": 1}, {"lane": 2}, []]),
    ("{}", {}), (" [1, 2] ", [1, 2]), ("-7", -7), ('"bare text"', "bare text"), ("null", None),
    ('tides: [0.5, [1.25]] metres', [0.5, [1.25]]), ('first [{"buoy":1},{"buoy":2}]', {"buoy": 1}),
    ('{"note": "}{", "log": {"marks": ["]"]}} end of log', {"note": "}{", "log": {"marks": ["]"]}}),
    ('it said {"quote": "up \\"here}\\""} twice', {"quote": 'up "here}"'}),
]
MENDED = [
    ('{"probe": "P-12", "depth": 9,}', {"probe": "P-12", "depth": 9}), ("{'sea': 'north', calm: True, wind: None}", {"sea": "north", "calm": True, "wind": None}),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('{"catch": [4, 8, {"net": "torn', {"catch": [4, 8, {"net": "torn"}]}), ('{"from": 1, // harbour\n "to": /* unknown */ 2}', {"from": 1, "to": 2}),
    ('{"log": "two\nlines"}', {"log": "two\nlines"}), ('{"twice":1,"twice":2}', {"twice": 2}), ('{"state": under way, "heading": -1.5e2}', {"state": "under way", "heading": -150.0}), ('{"u": "\\u00e9"', {"u": "é"}), ("[1, 2,, 3,]", [1, 2, 3]), ('{} x', {}),
]
BAD = ["", "  \n\t ", "no payload at all, sorry: {", None]
YAMLS = [
    ("probe: P-13\ndepth: 40", {"probe": "P-13", "depth": 40}), ("```yaml\nsea: north\n```", {"sea": "north"}), ("log\n```yml\nstops:\n  - 7\n```", {"stops": [7]}),
    ("This was sent by the boat:\nspeed: 6\nheading: 270\nThis is the end of it", {"speed": 6, "heading": 270}), ("crew:\n  - rank: cook\n  - rank: mate", {"crew": [{"rank": "cook"}, {"rank": "mate"}]}),
    ('{"speed": 6, "heading": 270}', {"speed": 6, "heading": 270}), ("{}", {}),
]


@pytest.mark.parametrize(("text", "want"), GOOD + MENDED)
def test_single_json(text, want):
    assert R.loads(text) == want


@pytest.mark.parametrize(("text", "want"), YAMLS)
def test_single_yaml(text, want):
    assert R.loads(text, "yaml") == want


def test_single_errors():
    for t in ("", "   \n  \t  "):
        with pytest.raises(ConversionError, match="Empty or whitespace-only text"):
            R.loads(t)
    with pytest.raises(ConversionError, match="Unsupported mode"):
        R.loads("{}", "xml")
    with pytest.raises(ConversionError, match="Failed to parse JSON"):
        R.loads('{"probe": "P-14",}', repair=False)
    with pytest.raises(ConversionError):
        R.loads("42", "yaml")


def test_columns_equal_single_calls(spark):
    texts = [t for t, _ in GOOD + MENDED] + BAD
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for repair in (True, False):
        for r in loads(df, "t", "r", repair=repair).select("i", "t", F.to_json("r.value").alias("v"), F.expr("r.value IS NULL").alias("none"), "r.error").collect():
            try:
                want = R.loads(r.t or "", repair=repair)
            except ConversionError as e:
                assert r.none and r.error == str(e), r
                continue
            assert r.error is None and json.loads(r.v) == want, r
    for r in loads(spark.createDataFrame([t for t, _ in YAMLS] + ["- 1\n- 2"], "string"), "value", "r", "yaml").select("value", F.to_json("r.value").alias("v"), "r.error").collect():
        if r.value.startswith("- 1"):
            assert r.v is None and "must be a dictionary" in r.error
        else:
            assert json.loads(r.v) == dict(YAMLS)[r.value]


def test_spans_equal_single_calls(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(['{', '}', '[', ']', '"', "\\", "a", " ", ":", "1", ",", '"k":1', "\n"], k=rng.randint(0, 25))) for _ in range(400)] + ["x" * 3000 + '{"a": {"b": 1}} {']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cols = [balanced(F.col("t"), o, c, k).alias(f"{n}{k}") for n, (o, c) in (("o", "{}"), ("a", "[]")) for k in (True, False)]
    for r in df.select("t", extract_json(F.col("t")).alias("x"), strict(F.col("t")).isNotNull().alias("s"), *cols).collect():
        for n, (o, c) in (("o", "{}"), ("a", "[]")):
            for k in (True, False):
                assert r[f"{n}{k}"] == R.balanced(r.t, o, c, k), (r.t, n, k)
        assert not r.s or R._valid(r.t)


def test_long_odd_texts_are_read_in_time(spark):
    """Neither the depth of a pattern nor the square of a text's length."""
    texts = ["{" + "{a}" * 5000 + "}", "{" + "{a}" * 330_000 + "}", " " * 1_000_000 + '{"a": 1}' + " " * 1_000_000, "x" + " " * 1_000_000 + "y", "a line " * 150_000, "{" * 100_000, '"' * 100_000 + "{", '{"a": [' + "1," * 300_000 + "2]} tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    began = time.monotonic()
    got = {r.i: r for r in loads(df, "t", "r").select("i", F.expr("try_variant_get(r.value, '$.a', 'string')").alias("a"), "r.error").collect()}
    assert time.monotonic() - began < 60
    assert got[2].a == "1" and got[2].error is None and got[7].a.count(",") == 300_000
    began = time.monotonic()
    assert validate(df, "t", {"type": "object", "required": ["a"]}, "v").where("v.is_valid").count() == 2
    assert time.monotonic() - began < 60


def test_columns_of_ones_own_names_stay(spark):
    df = spark.createDataFrame([('{"a": 1,}', "x", "y", "z")], "t string, __read string, __slow string, __fast string")
    r = validate(loads(df, "t", "l"), "t", {"required": ["a"]}, "v").first()
    assert (r.__getitem__("__read"), r.__getitem__("__slow"), r.__getitem__("__fast"), r.v.is_valid) == ("x", "y", "z", True)


def test_flat_spans():
    assert R.flat_spans("{a{b}c}{", "{", "}") == [(2, 5), (0, 7)] and R.flat_spans("{{{}}}", "{", "}") == [(2, 4), (1, 5)]
    assert R.embedded_json('{ {"abcdefghijklmnopq": {"c": 2}}') == '{"abcdefghijklmnopq": {"c": 2}}'
