"""Schema sources: a dict, a JSON text, a Pydantic class, a Spark StructType, or a catalog of schema texts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.errors import ConversionError, UnsupportedModelError


def to_schema(source: Any) -> dict[str, Any]:
    """A JSON Schema document of any source that stands for one schema."""
    if isinstance(source, T.StructType):
        return struct_schema(source)
    if isinstance(source, type) and hasattr(source, "model_json_schema"):
        try:
            return source.model_json_schema()
        except Exception as e:
            raise ConversionError(f"Failed to convert the model to a JSON schema: {e}") from e
    if isinstance(source, dict):
        return source
    if isinstance(source, str):
        try:
            got = json.loads(source)
        except ValueError as e:
            raise ConversionError(f"Failed to parse JSON schema string: {e}") from e
        if not isinstance(got, dict):
            raise ConversionError(f"Failed to parse JSON schema string: it holds a {type(got).__name__}, not an object")
        return got
    raise UnsupportedModelError(f"Unsupported model type: {type(source).__name__}. A Pydantic class, StructType, dict or JSON text is needed")


_ATOMS = (
    (T.StringType, {"type": "string"}), (T.BooleanType, {"type": "boolean"}), (T.IntegralType, {"type": "integer"}),
    (T.FractionalType, {"type": "number"}), (T.DateType, {"type": "string", "format": "date"}), (T.TimestampType, {"type": "string", "format": "date-time"}),
    (T.TimestampNTZType, {"type": "string", "format": "date-time"}), (T.DayTimeIntervalType, {"type": "string", "format": "duration"}),
    (T.BinaryType, {"type": "string", "contentEncoding": "base64"}), (T.NullType, {"type": "null"}),
)


def struct_schema(t: T.DataType) -> dict[str, Any]:
    """JSON Schema of a Spark type; fields that can't be null are required."""
    if isinstance(t, T.StructType):
        out: dict[str, Any] = {"type": "object", "properties": {f.name: struct_schema(f.dataType) | ({"description": f.metadata["comment"]} if f.metadata.get("comment") else {}) for f in t.fields}}
        required = [f.name for f in t.fields if not f.nullable]
        return out | ({"required": required} if required else {})
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": struct_schema(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": struct_schema(t.valueType)}
    return dict(next((s for k, s in _ATOMS if isinstance(t, k)), {}))


def catalog(spark: SparkSession, schemas: dict[str, Any]) -> DataFrame:
    """(schema_id, schema_json): a row for each named schema, as to_schema() reads it."""
    rows = [(k, json.dumps(to_schema(v), ensure_ascii=False)) for k, v in schemas.items()]
    return spark.createDataFrame(rows, "schema_id string, schema_json string")
