"""The SQL surface: functions and a table function that register() adds to a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessella.errors import TessellaError
from tessella.functions import interpret as I
from tessella.functions import repair as R
from tessella.functions.render import render
from tessella.functions.tokens import default_tokenizer
from tessella.plans.ir import compile_schema, walk
from tessella.sources.schemas import to_schema


@F.pandas_udf(StringType())
def schema_render(schemas: pd.Series, formats: pd.Series, metadata: pd.Series) -> pd.Series:
    """The text of each schema; null for one that can't be read."""

    def one(s, f, m):
        try:
            return None if s is None else render(s, f, bool(m))
        except TessellaError:
            return None

    return pd.Series([one(*x) for x in zip(schemas, formats, metadata, strict=True)], dtype="object")


def _loads(mode: str):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else R.dumps(R.loads(t, mode))
            except TessellaError:
                return None

        return pd.Series(map(one, texts), dtype="object")

    return run


@F.pandas_udf(StructType([StructField("is_valid", BooleanType()), StructField("errors", ArrayType(StringType()))]))
def validate_json(schemas: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Each text against the schema beside it, in auto mode."""
    made: dict[str, I.Interpreter] = {}
    ok, errors = [], []
    for s, t in zip(schemas, texts, strict=True):
        if s is None or t is None:
            ok.append(None)
            errors.append(None)
            continue
        if s not in made:
            made[s] = I.Interpreter(s)
        found = [I.describe(f) for f in made[s].failures(I.parse_data(t, I.which(t, "auto")))]
        ok.append(not found)
        errors.append(found or None)
    return pd.DataFrame({"is_valid": pd.Series(ok, dtype="object"), "errors": pd.Series(errors, dtype="object")})


@F.pandas_udf(LongType())
def token_count(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else default_tokenizer(t) for t in texts], dtype="Int64")


FIELDS = StructType([StructField(n, t) for n, t in (("path", StringType()), ("name", StringType()), ("type", StringType()), ("required", BooleanType()), ("place", IntegerType()))])


@F.udtf(returnType=FIELDS)
class SchemaFields:
    """A row for each field of a schema, in order."""

    def eval(self, schema_json: str) -> Iterator[tuple]:
        if schema_json is not None:
            yield from walk(compile_schema(to_schema(schema_json)))


def register(spark: SparkSession) -> None:
    """schema_render(schema, format, include_metadata), loads_json(text), loads_yaml(text), validate_json(schema, text), token_count(text); TABLE schema_fields(schema)."""
    for name, f in (("schema_render", schema_render), ("loads_json", _loads("json")), ("loads_yaml", _loads("yaml")), ("validate_json", validate_json), ("token_count", token_count)):
        spark.udf.register(name, f)
    spark.udtf.register("schema_fields", SchemaFields)


