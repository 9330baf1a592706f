import json
from enum import Enum
from typing import Literal, Optional

import pytest
from pydantic import BaseModel
from pyspark.sql import functions as F

from tessella.errors import AdapterParseError
from tessella.functions.render import Rendering
from tessella.functions.sql import register
from tessella.functions.tokens import SPLITS, bpe, compare_tokens, default_tokenizer, token_count
from tessella.operators.adapter import Signature, assistant_message, field_note, parse_completion, parse_completions, requirement, structure, user_message
from tessella.operators.schemas import catalog_fields, compare_catalog, render_catalog
from tessella.sources.schemas import catalog
from tessella.streaming.validation import split_stream, validity_rate


class Mood(Enum):
    good = "good"
    bad = "bad"


class Item(BaseModel):
    name: str
    tags: list[str] = []
    size: Optional[int] = None


SIGN = Signature({"question": str}, {"answer": str, "score": float, "mood": Mood, "item": Item, "kind": Literal["a", "b"], "flag": bool})
GOOD = {"answer": "yes", "score": 0.5, "mood": "good", "item": {"name": "n", "tags": ["t"]}, "kind": "a", "flag": True, "more": 1}


def test_prompt_texts():
    text = structure(SIGN)
    assert "[[ ## question ## ]]\n{question}" in text and "must be True or False" in text and "one of: good; bad" in text and "name*: string" in text
    assert field_note(str) == "" and '"properties"' in field_note(Item, "json") and "name*" in field_note(Item, "yaml") and "JSON schema" in field_note(list[Item])
    assert requirement(SIGN, "yaml").startswith("Respond with a YAML-style object in the following order of fields: `answer`, then `score`")
    assert json.loads(assistant_message({"answer": "x"}, SIGN))["flag"].startswith("Not supplied") and "answer: x" in assistant_message({"answer": "x"}, SIGN, "yaml")
    closed = SIGN.schema()
    assert closed["additionalProperties"] is False and closed["$defs"]["Item"]["required"] == ["name", "tags", "size"]
    with pytest.raises(ValueError):
        Signature({}, {"d": dict[str, int]}).schema()
    with pytest.raises(ValueError):
        structure(SIGN, "xml")


def test_single_completion():
    got = parse_completion(f"Well: {json.dumps(GOOD)} ok", SIGN)
    assert got["mood"] is Mood.good and got["item"].name == "n" and "more" not in got
    assert parse_completion("a: 1\nb: x", Signature({}, {"a": int, "b": str}), "yaml") == {"a": 1, "b": "x"}
    for bad in ("[1]", '{"answer": 1}', "", json.dumps(GOOD | {"score": "x"})):
        with pytest.raises(AdapterParseError):
            parse_completion(bad, SIGN)


def test_completion_columns(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), ('{"answer": "x"}',), ("[1]",), (None,), ("```json\n" + json.dumps(GOOD)[:-1] + ",}\n```",)], "t string")
    rows = parse_completions(df, "t", SIGN).collect()
    assert rows[0].fields.score == 0.5 and rows[0].fields.item.tags == ["t"] and rows[4].fields == rows[0].fields
    assert rows[1].error == "Missing fields: score, mood, item, kind, flag" and rows[2].error == "The completion holds no object" and rows[3].error.startswith("Empty")
    y = parse_completions(spark.createDataFrame([("a: 1\nb: x",), ('{"a": 2, "b": "y",}',)], "t string"), "t", Signature({}, {"a": int, "b": str}), mode="yaml").collect()
    assert [tuple(r.fields) for r in y] == [(1, "x"), (2, "y")]
    p = spark.createDataFrame([("why?",)], "question string").select(user_message(SIGN).alias("p"), assistant_message(F.struct(*[F.lit("v").alias(k) for k in SIGN.outputs]), SIGN).alias("a")).first()
    assert p.p.startswith("[[ ## question ## ]]\nwhy?\n\nRespond with a JSON object") and json.loads(p.a)["mood"] == "v"


class Level(Enum):
    low = 1
    high = 2


@pytest.mark.parametrize("outputs", [{"key": int, "kind": Literal["a", "b"]}, {"ratio": float, "on": bool}, {"level": Level, "note": Optional[str]}, {"item": Item, "key": int}, {"all": list[int], "by": dict[str, float]}])
def test_columns_cast_as_single_calls_do(spark, outputs):
    values = ["abc", "a", "12", "1.5", "yes", "", 0, 1, 2, 2.0, 2.5, True, None, [1, "2"], ["x"], {"a": 1}, {"name": "n"}, {"name": 3}, {"name": "n", "tags": ["t"], "size": "4"}]
    rows = [json.dumps(dict(zip(outputs, pair, strict=True))) for i, x in enumerate(values) for pair in ((x, values[(i * 7 + 1) % len(values)]), (x, 1), (x, "a"), (x, None), (x, {"a": "1.5"}))]
    sign = Signature({}, outputs)
    got = parse_completions(spark.createDataFrame([(t,) for t in rows], "t string"), "t", sign).collect()
    for r in got:
        try:
            parse_completion(r.t, sign)
        except AdapterParseError as e:
            assert (r.error, r.fields) == (str(e), None), r.t
        else:
            assert r.error is None and r.fields is not None, (r.t, r.error)
    assert 0 < sum(r.error is None for r in got) < len(got)
    with pytest.raises(ValueError):
        parse_completions(spark.createDataFrame([("{}", 1)], "t string, error int"), "t", sign)


def test_renderings_and_messages(spark):
    r = Rendering(Item, "yaml")
    assert str(r) == r.to_string() and "name" in str(r) and repr(r) == "Rendering(format='yaml')"
    assert r.token_count() == default_tokenizer(str(r)) and r.compare_tokens()["simplified_tokens"] == r.token_count()
    s = Signature({}, {"a": int, "b": str, "c": list[float], "d": bool})
    df = spark.createDataFrame([(1, "x: y", [0.5], True), (2, None, [], False)], "a long, b string, c array<double>, d boolean")
    for mode in ("jsonish", "yaml"):
        made = [x.m for x in df.select(assistant_message(F.struct("a", "b", "c", "d"), s, mode).alias("m")).collect()]
        assert made == [assistant_message({"a": 1, "b": "x: y", "c": [0.5], "d": True}, s, mode), assistant_message({"a": 2, "c": [], "d": False}, s, mode)]


def test_tokens(spark, tmp_path):
    texts = ["", "two words", "a-b  12 é\n", "{'k': 1}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [default_tokenizer(t) for t in texts]
    own = [r[0] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(token_count(F.col("t"), len)).collect()]
    assert own == [*map(len, texts), None]
    c = compare_tokens(Item, "short")
    assert c["tokens_saved"] == c["original_tokens"] - 1 and c["reduction_percent"] > 90
    import public_tokenizers

    assert bpe(public_tokenizers.path("byte_bpe_50k.json"))("two words") == bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))("two words") == 2
    assert bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), "cl100k_base")("12345") != bpe("x/cl100k_base.tiktoken").split == SPLITS["cl100k_base"]


def test_catalog_and_sql(spark):
    c = catalog(spark, {"item": Item, "text": '{"type": "string"}'})
    assert {r.schema_id: r.text for r in render_catalog(c).collect()}["text"] == "string"
    assert compare_catalog(c).where("tokens.tokens_saved > 0").count() == 2
    assert [(r.path, r.required) for r in catalog_fields(c).collect()] == [("name", True), ("tags", False), ("size", False)]
    register(spark)
    c.createOrReplaceTempView("c")
    assert spark.sql("SELECT schema_render(schema_json, 'typescript', true) t FROM c WHERE schema_id = 'text'").first().t == "type Schema = string;"
    assert spark.sql("SELECT f.name FROM c, LATERAL schema_fields(schema_json) f").count() == 3
    assert spark.sql("SELECT loads_yaml('a: 1') y, loads_json('nope {') j, validate_json('{\"type\": \"string\"}', '{}').errors e").first().e[0].startswith("Validation error")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'{{"k": {i}}}' if i % 3 else "{oops") for i in range(30)], "i int, t string").withColumn("ts", F.expr("timestamp_seconds(i * 60)"))
    rows.write.parquet(str(tmp_path / "in"))
    schema = {"properties": {"k": {"maximum": 20}}, "required": ["k"]}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    good, bad = split_stream(stream, "t", schema)
    for name, part in (("good", good), ("bad", bad)):
        part.writeStream.format("memory").queryName(name).start().processAllAvailable()
    n = rows.selectExpr("count_if(i % 3 != 0 AND i <= 20)").first()[0]
    assert spark.table("good").count() == n and spark.table("bad").count() == 30 - n
    q = validity_rate(stream, "t", schema, "ts").writeStream.outputMode("complete").format("memory").queryName("rate").start()
    q.processAllAvailable()
    assert sorted(map(tuple, spark.table("rate").collect())) == sorted(map(tuple, validity_rate(rows, "t", schema, "ts").collect()))
    for q in spark.streams.active:
        q.stop()
