"""Typed signatures to prompts, and completions back to typed columns. No model is called here: prompts and completions are columns."""

from __future__ import annotations

import enum
import json
import types
import typing
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import AdapterParseError
from tessella.functions import repair as R
from tessella.functions.extract import loads, spare
from tessella.functions.render import render
from tessella.plans.validator import Kinds, any_of, equals

MODES = ("json", "jsonish", "yaml")
# The sentences of prompts, here and below.
NOTE = "        # note: the value you produce "


@dataclass(frozen=True)
class Signature:
    """Ordered input and output fields with their types: a Python type, an Enum, a Literal or a Pydantic class."""

    inputs: dict[str, Any] = field(default_factory=dict)
    outputs: dict[str, Any] = field(default_factory=dict)

    def schema(self) -> dict[str, Any]:
        """JSON Schema of the outputs: closed and with every property required, at every depth."""
        from pydantic import create_model

        for name, t in self.outputs.items():
            if t is dict or typing.get_origin(t) is dict:
                raise ValueError(f"Field {name} is an open dict, which has no closed schema")
        return closed(create_model("Outputs", **{k: (t, ...) for k, t in self.outputs.items()}).model_json_schema())


def closed(s: Any) -> Any:
    if isinstance(s, list):
        return [closed(x) for x in s]
    if not isinstance(s, dict):
        return s
    out = {k: closed(v) for k, v in s.items()}
    if s.get("type") == "object" or "properties" in s:
        out |= {"required": list(s.get("properties", {})), "additionalProperties": False}
    return out


def field_note(t: Any, mode: str = "jsonish") -> str:
    """What is said of a field of this type; nothing of a text."""
    if t is str:
        return ""
    if t is bool:
        said = "must be True or False"
    elif t is int or t is float:
        said = f"must be a single {t.__name__} value"
    elif isinstance(t, type) and issubclass(t, enum.Enum):
        said = f"must be one of: {'; '.join(str(e.value) for e in t)}"
    elif typing.get_origin(t) is typing.Literal:
        said = f"must exactly match (no extra characters) one of: {'; '.join(map(str, typing.get_args(t)))}"
    else:
        said = complex_note(t, mode)
    return NOTE + said


def complex_note(t: Any, mode: str) -> str:
    from pydantic import TypeAdapter

    schema = t.model_json_schema() if hasattr(t, "model_json_schema") else TypeAdapter(t).json_schema()
    if mode == "json" or not hasattr(t, "model_json_schema"):
        return f"must adhere to the JSON schema: {json.dumps(schema, ensure_ascii=False)}"
    return f"must adhere to the {'YAML' if mode == 'yaml' else 'JSON'} schema: \n{render(schema, 'yaml' if mode == 'yaml' else 'jsonish', include_metadata=False)}"


def structure(signature: Signature, mode: str = "jsonish") -> str:
    """How inputs look and how outputs must."""
    if mode not in MODES:
        raise ValueError(f"Unsupported mode: {mode}. Use one of {', '.join(MODES)}")
    ins = [f"[[ ## {k} ## ]]\n{{{k}}}{field_note(t, mode)}" for k, t in signature.inputs.items()]
    marks = {k: f"{{{k}}}{field_note(t, mode)}" for k, t in signature.outputs.items()}
    outs = "\n".join(f"{k}: {v}" for k, v in marks.items()) if mode == "yaml" else json.dumps(marks, indent=2, ensure_ascii=False)
    kind = "YAML" if mode == "yaml" else "JSON"
    return "\n\n".join(["All interactions will be structured in the following way, with the appropriate values filled in.", "Inputs will have the following structure:", *ins, f"Outputs will be a {kind} object with the following fields.", outs])


def requirement(signature: Signature, mode: str = "jsonish") -> str:
    kind = "YAML-style" if mode == "yaml" else "JSON"
    hints = [f"`{k}`" + (f" (must be formatted as a valid Python {t.__name__ if hasattr(t, '__name__') else t})" if t is not str else "") for k, t in signature.outputs.items()]
    return f"Respond with a {kind} object in the following order of fields: {', then '.join(hints)}."


def user_message(signature: Signature, mode: str = "jsonish") -> Column:
    """The inputs, which are columns of their names, and the requirement."""
    parts = [F.concat(F.lit(f"[[ ## {k} ## ]]\n"), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in signature.inputs]
    return F.concat_ws("\n\n", *parts, F.lit(requirement(signature, mode)))


def assistant_message(values: dict[str, Any] | Column, signature: Signature, mode: str = "jsonish", missing: str = "Not supplied for this particular example.") -> str | Column:
    """The outputs as a model would write them: of a dict, or as a column of a struct column; null fields count as missing."""
    names = list(signature.outputs)

    def one(given: dict[str, Any]) -> str:
        filled = {k: given.get(k, missing) for k in names}
        return yaml.dump(filled, default_flow_style=False, allow_unicode=True).strip() if mode == "yaml" else json.dumps(filled, indent=2, ensure_ascii=False)

    if not isinstance(values, Column):
        return one(values)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else one(json.loads(r)) for r in rows], dtype="object")

    return run(F.to_json(F.struct(*[values[k].alias(k) for k in names])))


def spark_type(t: Any) -> T.DataType:
    if isinstance(t, type) and issubclass(t, enum.Enum):
        return T.StringType()
    for k, s in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
        if t is k:
            return s
    origin, args = typing.get_origin(t), typing.get_args(t)
    if origin is list:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(T.StringType(), spark_type(args[1]))
    if origin in (typing.Union, types.UnionType):
        return spark_type(next(a for a in args if a is not type(None)))
    if origin is typing.Literal:
        return spark_type(type(args[0]))
    if hasattr(t, "model_fields"):
        return T.StructType([T.StructField(k, spark_type(f.annotation)) for k, f in t.model_fields.items()])
    return T.StringType()


def parse_completions(df: DataFrame, column: str, signature: Signature, output: str = "fields", mode: str = "jsonish", error: str = "error") -> DataFrame:
    """df with the outputs as a typed struct, null where `error` (beside it) says why: no object, not all of the fields, or values that aren't of their types."""
    if {output.lower(), error.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"There is a column {output} or {error} already: name others by `output` and `error`")
    loaded, other = spare(df, "__loaded", "__json")
    read = loads(df, column, loaded, "yaml" if mode == "yaml" else "json")
    if mode == "yaml":  # what YAML can't read may be JSON
        read = loads(read, column, other).withColumn(loaded, F.when(F.col(f"{loaded}.error").isNull(), F.col(loaded)).otherwise(F.col(other))).drop(other)
    v = F.col(f"{loaded}.value")
    parts = {k: F.try_variant_get(v, f'$["{k}"]', "variant") for k in signature.outputs}
    named = lambda tests: F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])), ", ")
    kind = F.schema_of_variant(v).startswith("OBJECT")
    lost = named({k: x.isNull() for k, x in parts.items()})
    if all(map(_simple, signature.outputs.values())):
        fields = F.struct(*[F.try_variant_get(parts[k], "$", spark_type(t).simpleString()).alias(k) for k, t in signature.outputs.items()])
        wrong = named({k: ~F.coalesce(_fits(parts[k], t), F.lit(False)) for k, t in signature.outputs.items()})
    else:  # models and containers are checked as single completions are
        cast = _cast_udf(signature)(F.to_json(v))
        fields = F.from_json(cast["json"], T.StructType([T.StructField(k, spark_type(t)) for k, t in signature.outputs.items()]))
        wrong = F.coalesce(cast["wrong"], F.lit(""))
    problem = F.coalesce(F.col(f"{loaded}.error"), F.when(~F.coalesce(kind, F.lit(False)), F.lit("The completion holds no object")), F.when(lost != "", F.concat(F.lit("Missing fields: "), lost)), F.when(wrong != "", F.concat(F.lit("Invalid fields: "), wrong)))
    out = read.withColumn(error, problem)
    return out.withColumn(output, F.when(F.col(error).isNull(), fields)).drop(loaded)


def _simple(t: Any) -> bool:
    if typing.get_origin(t) in (typing.Union, types.UnionType):
        return all(a is type(None) or _simple(a) for a in typing.get_args(t))
    return t in (bool, int, float, str) or bool(_choices(t)) and all(type(x) is str for x in _choices(t))


def _choices(t: Any) -> list:
    """The values of an Enum or a Literal."""
    if isinstance(t, type) and issubclass(t, enum.Enum):
        return [e.value for e in t]
    return list(typing.get_args(t)) if typing.get_origin(t) is typing.Literal else []


def _fits(v: Column, t: Any) -> Column:
    """Whether a VARIANT is a value of a simple type, or a text or number that stands for one."""
    k = Kinds(v)
    if typing.get_origin(t) in (typing.Union, types.UnionType):
        return any_of([k.of("null") if a is type(None) else _fits(v, a) for a in typing.get_args(t)])
    if t is str:
        return k.string
    if t is bool:
        return k.of("boolean") | k.of("integer") & k.value.isin(0.0, 1.0) | k.string & F.lower(k.text).isin("0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes")
    if t is int:
        return k.of("integer") | k.of("boolean") | k.string & F.trim(k.text).rlike(r"^[+-]?[0-9]+(\.0+)?$")
    if t is float:
        return k.number | k.of("boolean") | k.string & F.trim(k.text).try_cast("double").isNotNull()
    return any_of([equals(v, k, x) for x in _choices(t)])


def _cast(got: dict[str, Any], signature: Signature) -> tuple[dict[str, Any], list[str]]:
    """The outputs as values of their types, and the names of those that aren't."""
    from pydantic import TypeAdapter, ValidationError

    out, wrong = {}, []
    for k, t in signature.outputs.items():
        try:
            out[k] = TypeAdapter(t).validate_python(got[k])
        except ValidationError:
            wrong.append(k)
    return out, wrong


def _cast_udf(signature: Signature):
    @F.pandas_udf("json string, wrong string")
    def run(texts: pd.Series) -> pd.DataFrame:
        from pydantic import TypeAdapter

        made, wrongs = [], []
        for t in texts:
            got = json.loads(t) if t is not None else None
            if not isinstance(got, dict) or any(k not in got for k in signature.outputs):
                made.append(None)
                wrongs.append(None)
                continue
            out, wrong = _cast(got, signature)
            made.append(None if wrong else json.dumps({k: TypeAdapter(t).dump_python(out[k], mode="json") for k, t in signature.outputs.items()}))
            wrongs.append(", ".join(wrong))
        return pd.DataFrame({"json": pd.Series(made, dtype="object"), "wrong": pd.Series(wrongs, dtype="object")})

    return run


def parse_completion(text: str, signature: Signature, mode: str = "jsonish") -> dict[str, Any]:
    """One completion. Fields beyond the signature's go."""
    try:
        try:
            got = R.loads(text, "yaml" if mode == "yaml" else "json")
        except Exception:
            if mode != "yaml":
                raise
            got = R.loads(text)
    except Exception as e:
        raise AdapterParseError(str(e)) from e
    if not isinstance(got, dict):
        raise AdapterParseError("The completion holds no object")
    lost = [k for k in signature.outputs if k not in got]
    if lost:
        raise AdapterParseError(f"Missing fields: {', '.join(lost)}")
    out, wrong = _cast(got, signature)
    if wrong:
        raise AdapterParseError(f"Invalid fields: {', '.join(wrong)}")
    return out
