"""Operators on DataFrames of schemas: render a catalog, measure it, list its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.render import FORMATS
from tessella.functions.sql import SchemaFields, schema_render
from tessella.functions.tokens import Tokenizer, comparison


def render_catalog(catalog: DataFrame, format: str = "jsonish", include_metadata: bool = True, column: str = "schema_json", output: str = "text") -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"Unsupported format: {format}. Use one of {', '.join(FORMATS)}")
    return catalog.withColumn(output, schema_render(F.col(column), F.lit(format), F.lit(include_metadata)))


def compare_catalog(catalog: DataFrame, format: str = "jsonish", tokenizer: Tokenizer | None = None, column: str = "schema_json") -> DataFrame:
    """The catalog with a struct `tokens`: what its rendering saves over its JSON."""
    rendered = render_catalog(catalog, format, column=column, output="__text")
    return rendered.withColumn("tokens", comparison(F.col(column), F.col("__text"), tokenizer)).drop("__text")


def catalog_fields(catalog: DataFrame, column: str = "schema_json") -> DataFrame:
    """A row for each field of each schema: the catalog's columns, then path, name, type, required, place."""
    return catalog.lateralJoin(SchemaFields(F.col(column).outer()))
