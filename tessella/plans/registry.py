"""Queries over the driver's tables, one for each operator, each with the SQL that says the same.

Texts are put together by concat of columns, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.extract import loads
from tessella.functions.sql import register
from tessella.functions.tokens import PATTERN, comparison
from tessella.operators.adapter import Signature, assistant_message, parse_completions, user_message
from tessella.operators.schemas import catalog_fields, compare_catalog, render_catalog
from tessella.plans import features
from tessella.plans.validator import validate
from tessella.sources.schemas import catalog, struct_schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EVENT = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}}, "required": ["k"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(features.QUERIES)
SQL: dict[str, str] = dict(features.SQL)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("validate_event_rate", """SELECT event_type, count(*) AS n_rows, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49) AS n_valid,
  count(*) FILTER (NOT coalesce(CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49, FALSE)) AS n_invalid FROM events GROUP BY event_type""")
def validate_event_rate(spark: SparkSession, d: str) -> DataFrame:
    checked = validate(table(spark, d, "events").select("event_type", "props"), "props", EVENT, "r")
    return checked.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if("r.is_valid").alias("n_valid"), F.count_if(~F.col("r.is_valid")).alias("n_invalid"))


def loaded(name: str, text: str, out: dict[str, str], sql: str, source: str = "events", key: str = "event_id", mode: str = "json", repair: bool = True) -> None:
    """A query that loads `text` (SQL of both engines) and picks parts of the value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = loads(table(spark, d, source).select(key, F.expr(text).alias("t")), "t", "r", mode, repair)
        return rows.select(key, *[F.expr(x).alias(n) for n, x in out.items()])

    query(name, f"SELECT {key}, {sql} FROM {source}")(run)


K = {"k": "try_variant_get(r.value, '$.k', 'bigint')"}
K_SQL = "CAST(json_extract(props, '$.k') AS BIGINT) AS k"
loaded("loads_fenced_json", "concat('Look: ```json', chr(10), props, chr(10), '``` done')", K, K_SQL)
loaded("loads_embedded_json", "concat('The data is: ', props, ' and that is all.')", K, K_SQL)
loaded("loads_embedded_array", "concat('values [1, 2, ', event_id, '] end')", {"third": "try_variant_get(r.value, '$[2]', 'bigint')"}, "event_id AS third")
loaded("loads_object_before_array", "concat('text [', props, ',{\"k\": -1}]')", K, K_SQL)
loaded("loads_invalid_no_repair", "concat(substr(props, 1, length(props) - 1), ',}')", {"error": "r.error", "is_null": "r.value IS NULL"}, "concat('Failed to parse JSON: ', substr(props, 1, length(props) - 1), ',}...') AS error, TRUE AS is_null", repair=False)
loaded("loads_repair_trailing_comma", "concat(substr(props, 1, length(props) - 1), ',}')", K, K_SQL)
loaded("loads_repair_quotes", "concat('{', chr(39), 'k', chr(39), ': ', event_id, ', ok: True, // note', chr(10), 'w: word}')", {"k": K["k"], "ok": "try_variant_get(r.value, '$.ok', 'boolean')", "w": "try_variant_get(r.value, '$.w', 'string')"}, "event_id AS k, TRUE AS ok, 'word' AS w")
loaded("loads_repair_truncated", "substr(concat('{\"k\": ', event_id, ', \"list\": [1, 2, ', event_id), 1)", {"k": K["k"], "last": "try_variant_get(r.value, '$.list[2]', 'bigint')"}, "event_id AS k, event_id AS last")
loaded("loads_empty", "CASE WHEN event_id % 2 = 0 THEN '  ' ELSE props END", {"error": "r.error"}, "CASE WHEN event_id % 2 = 0 THEN 'Empty or whitespace-only text' END AS error")
NATION = {"name": "try_variant_get(r.value, '$.name', 'string')", "region": "try_variant_get(r.value, '$.region', 'int')"}
NATION_SQL = "n_name AS name, n_regionkey AS region"
PLAIN = "concat('name: ', n_name, chr(10), 'region: ', n_regionkey)"
loaded("loads_yaml_plain", PLAIN, NATION, NATION_SQL, "nation", "n_nationkey", "yaml")
loaded("loads_yaml_fenced", f"concat('So:', chr(10), '```yaml', chr(10), {PLAIN}, chr(10), '```')", NATION, NATION_SQL, "nation", "n_nationkey", "yaml")
loaded("loads_longest_candidate", "concat('{ ', props)", K, K_SQL)
loaded("loads_yaml_repair", f"concat('```yaml', chr(10), 'note [', chr(10), {PLAIN}, chr(10), '```')", NATION, NATION_SQL, "nation", "n_nationkey", "yaml")
loaded("loads_yaml_indent", "concat('```yml', chr(10), '   name: ', n_name, chr(10), '   region: ', n_regionkey, chr(10), '  note [', chr(10), '```')", NATION, NATION_SQL, "nation", "n_nationkey", "yaml")
loaded("loads_yaml_prose", f"concat('Here is the config:', chr(10), {PLAIN}, chr(10), 'That is all.')", NATION, NATION_SQL, "nation", "n_nationkey", "yaml")


def checked(name: str, text: str, schema: Any, sql: str, source: str = "part", key: str = "p_partkey", mode: str = "auto") -> None:
    """A query that validates `text` under a schema; sql says when it holds."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return validate(table(spark, d, source).select(key, F.expr(text).alias("t")), "t", schema, "r", mode).select(key, F.col("r.is_valid").alias("is_valid"))

    query(name, f"SELECT {key}, ({sql}) AS is_valid FROM {source}")(run)


def prop(schema: Any) -> dict:
    return {"type": "object", "properties": {"v": schema}}


SIZE, BRAND, NAME = "concat('{\"v\": ', p_size, '}')", "concat('{\"v\": \"', p_brand, '\"}')", "concat('{\"v\": \"', p_name, '\"}')"
checked("validate_required", "concat('{\"a\": 1', CASE WHEN p_size % 2 = 0 THEN ', \"b\": null' ELSE '' END, '}')", {"required": ["a", "b"]}, "p_size % 2 = 0")
checked("validate_type", "concat('{\"v\": ', CASE WHEN p_size % 3 = 0 THEN '\"x\"' WHEN p_size % 3 = 1 THEN '1.0' ELSE '1.5' END, '}')", prop({"type": "integer"}), "p_size % 3 = 1")
checked("validate_type_list", "concat('{\"v\": ', CASE WHEN p_size % 3 = 0 THEN 'null' WHEN p_size % 3 = 1 THEN 'true' ELSE '\"s\"' END, '}')", prop({"type": ["string", "null"]}), "p_size % 3 <> 1")
checked("validate_range", SIZE, prop({"minimum": 10, "exclusiveMaximum": 40}), "p_size >= 10 AND p_size < 40")
checked("validate_length", NAME, prop({"minLength": 5, "maxLength": 15}), "length(p_name) BETWEEN 5 AND 15")
checked("validate_pattern", BRAND, prop({"pattern": "#[1-3]"}), "regexp_matches(p_brand, '#[1-3]')")
checked("validate_enum", SIZE, prop({"enum": [1, 2, 3, 5, 8, 13, 21, 34]}), "p_size IN (1, 2, 3, 5, 8, 13, 21, 34)")
checked("validate_const", SIZE, prop({"const": 7}), "p_size = 7")
checked("validate_multiple_of", SIZE, prop({"multipleOf": 4}), "p_size % 4 = 0")
checked("validate_format_email", "concat('{\"v\": \"a', CASE WHEN p_size % 2 = 0 THEN '@' ELSE '.' END, 'b\"}')", prop({"format": "email"}), "p_size % 2 = 0")
checked("validate_array_items", "concat('[1, ', p_size, ', 3]')", {"items": {"maximum": 20}}, "p_size <= 20")
checked("validate_prefix_items", "concat('[\"s\", ', p_size, ', true]')", {"prefixItems": [{"type": "string"}, {"minimum": 5}], "items": {"type": "boolean"}}, "p_size >= 5")
checked("validate_unique_items", "concat('[1, 2, ', p_size, ']')", {"uniqueItems": True, "minItems": 3}, "p_size NOT IN (1, 2)")
checked("validate_contains", "concat('[1, ', p_size, ']')", {"contains": {"minimum": 25}, "maxContains": 1}, "p_size >= 25")
checked("validate_additional_props", "concat('{\"a\": 1, \"x', p_size % 3, '\": 2}')", {"properties": {"a": {}, "x0": {}}, "patternProperties": {"1$": True}, "additionalProperties": False}, "p_size % 3 < 2")
checked("validate_property_names", "concat('{\"', CASE WHEN p_size % 2 = 0 THEN '9' ELSE 'k' END, '\": 1}')", {"propertyNames": {"pattern": "^[a-z]"}}, "p_size % 2 = 1")
checked("validate_dependent_required", "concat('{\"card\": 1', CASE WHEN p_size % 2 = 0 THEN ', \"address\": 2' ELSE '' END, '}')", {"dependentRequired": {"card": ["address"]}}, "p_size % 2 = 0")
checked("validate_anyof", SIZE, prop({"anyOf": [{"maximum": 10}, {"minimum": 40}]}), "p_size <= 10 OR p_size >= 40")
checked("validate_oneof", SIZE, prop({"oneOf": [{"maximum": 30}, {"minimum": 20}]}), "p_size < 20 OR p_size > 30")
checked("validate_allof_not", SIZE, prop({"allOf": [{"minimum": 10}, {"not": {"multipleOf": 5}}]}), "p_size >= 10 AND p_size % 5 <> 0")
checked("validate_if_then_else", "concat('{\"v\": ', p_size, ', \"w\": ', p_size % 7, '}')", {"if": {"properties": {"v": {"maximum": 25}}}, "then": {"properties": {"w": {"maximum": 3}}}, "else": {"properties": {"w": {"minimum": 3}}}}, "CASE WHEN p_size <= 25 THEN p_size % 7 <= 3 ELSE p_size % 7 >= 3 END")
checked("validate_recursive_ref", "concat('{\"n\": {\"n\": {\"v\": ', p_size, '}}}')", {"$ref": "#/$defs/t", "$defs": {"t": {"properties": {"n": {"$ref": "#/$defs/t"}, "v": {"maximum": 20}}}}}, "p_size <= 20")
checked("validate_unevaluated", "concat('{\"a\": 1, \"b', p_size % 2, '\": 2}')", {"allOf": [{"properties": {"a": {}, "b0": {}}}], "unevaluatedProperties": False}, "p_size % 2 = 0")
checked("validate_min_properties", "concat('{\"a\": 1', CASE WHEN p_size % 2 = 0 THEN ', \"b\": 2' ELSE '' END, '}')", {"minProperties": 2}, "p_size % 2 = 0")
checked("validate_max_properties", "concat('{\"a\": 1', CASE WHEN p_size % 2 = 0 THEN ', \"b\": 2' ELSE '' END, '}')", {"maxProperties": 1}, "p_size % 2 = 1")
checked("validate_dependent_schemas", "concat('{\"v\": ', p_size, CASE WHEN p_size % 2 = 0 THEN ', \"card\": 1' ELSE '' END, '}')", {"dependentSchemas": {"card": {"properties": {"v": {"maximum": 20}}}}}, "p_size % 2 = 1 OR p_size <= 20")
checked("validate_unevaluated_items", "concat('[1, ', CASE WHEN p_size % 2 = 0 THEN '\"x\"' ELSE '2' END, ']')", {"prefixItems": [True], "unevaluatedItems": {"type": "integer"}}, "p_size % 2 = 1")
checked("validate_format_ipv4", "concat('{\"v\": \"10.0.', p_size * 6, '.1\"}')", prop({"format": "ipv4"}), "p_size * 6 <= 255")
checked("validate_format_ipv6", "concat('{\"v\": \"fe80::', CASE WHEN p_size % 2 = 0 THEN 'g' ELSE 'a' END, '\"}')", prop({"format": "ipv6"}), "p_size % 2 = 1")
checked("validate_format_date", "concat('{\"v\": \"2023-02-', lpad(CAST(p_size AS STRING), 2, '0'), '\"}')", prop({"format": "date"}), "p_size <= 28")
checked("validate_format_time", "concat('{\"v\": \"', lpad(CAST(p_size AS STRING), 2, '0'), ':00:00\"}')", prop({"format": "time"}), "p_size < 24")
checked("validate_format_uuid", "concat('{\"v\": \"12345678-1234-1234-1234-1234567890', lpad(CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END, '0'), '\"}')", prop({"format": "uuid"}), "p_size % 2 = 0")
checked("validate_format_regex", "concat('{\"v\": \"a', CASE WHEN p_size % 2 = 0 THEN '(' ELSE '+' END, '\"}')", prop({"format": "regex"}), "p_size % 2 = 1")
checked("validate_large_numbers", "concat('{\"v\": ', CAST(9007199254740992 + p_size % 3 AS STRING), '}')", prop({"maximum": 9007199254740993}), "p_size % 3 <= 1")
checked("validate_pattern_unicode", "concat('{\"v\": \"', CASE WHEN p_size % 2 = 0 THEN chr(233) ELSE 'x y' END, '\"}')", prop({"pattern": r"^\w+$"}), "p_size % 2 = 0")
checked("validate_anchor", "concat('{\"v\": ', p_size, '}')", {"properties": {"v": {"$ref": "#few"}}, "$defs": {"x": {"$anchor": "few", "maximum": 20}}}, "p_size <= 20")
checked("validate_text_in_json_mode", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat('{\"v\": ', p_size, '}') END", {"type": "string"}, "p_size % 2 = 0", mode="json")
checked("validate_yaml", "concat('v: ', p_size)", prop({"maximum": 20}), "p_size <= 20", mode="yaml")
checked("validate_auto_mode", "CASE WHEN p_size % 2 = 0 THEN concat('{\"v\": ', p_size, '}') ELSE concat('v: ', p_size) END", prop({"maximum": 20}), "p_size <= 20")


@query("validate_error_messages", """SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'Validation error at '' (root)'': ''w'' is a required property (got dict) - Required properties: [''w'']'
  ELSE concat('Validation error at ''.v'': ', p_size, ' is greater than the maximum of 20 (got ', p_size, ') - Constraint: maximum = 20|Validation error at '' (root)'': ''w'' is a required property (got dict) - Required properties: [''w'']') END AS messages FROM part""")
def validate_error_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(SIZE).alias("t"))
    return validate(rows, "t", prop({"maximum": 20}) | {"required": ["w"]}, "r").select("p_partkey", F.array_join("r.errors", "|").alias("messages"))


@query("validate_first_error_only", """SELECT p_partkey, CASE WHEN p_size > 20 THEN concat('Validation error at ''.v'': ', p_size, ' is greater than the maximum of 20 (got ', p_size, ') - Constraint: maximum = 20')
  ELSE 'Validation error at '' (root)'': ''w'' is a required property (got dict) - Required properties: [''w'']' END AS first_message, CAST(1 AS INTEGER) AS n_errors FROM part""")
def validate_first_error_only(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(SIZE).alias("t"))
    checked_ = validate(rows, "t", prop({"maximum": 20}) | {"required": ["w"]}, "r", first_only=True)
    return checked_.select("p_partkey", F.col("r.errors")[0].alias("first_message"), F.size("r.errors").alias("n_errors"))


def tables_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, {t: struct_schema(table(spark, d, t).schema) for t in TABLES}).withColumnRenamed("schema_id", "table_name")


def rendered(format: str, type_sql: str, line: str, head: str, tail: str, between: str) -> None:
    names = ", ".join(f"'{t}'" for t in TABLES)
    sql = f"""SELECT table_name, concat('{head}', string_agg({line}, '{between}' ORDER BY column_index), '{tail}') AS text FROM (SELECT table_name, column_name, column_index, {type_sql} AS t
      FROM duckdb_columns() WHERE table_name IN ({names})) GROUP BY table_name"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return render_catalog(tables_catalog(spark, d), format).select("table_name", "text")

    query(f"render_{format}_tables", sql.replace("\\n", "' || chr(10) || '"))(run)


rendered("jsonish", "CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type = 'FLOAT[]' THEN 'float []' WHEN data_type LIKE 'TIMESTAMP%' THEN 'string (FORMAT: date-time)' ELSE 'string' END", "concat('  ', column_name, ': ', t)", "{\\n", "\\n}", ",\\n")
rendered("typescript", "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'number' WHEN data_type = 'FLOAT[]' THEN 'Array<number>' WHEN data_type LIKE 'TIMESTAMP%' THEN 'string' ELSE 'string' END || CASE WHEN data_type LIKE 'TIMESTAMP%' THEN '  // format: date-time' ELSE '' END", "concat('  ', column_name, ': ', t, ';')", "interface Schema {\\n", "\\n}", "\\n")
rendered("yaml", "CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type = 'FLOAT[]' THEN 'list[float]' WHEN data_type LIKE 'TIMESTAMP%' THEN '''string (FORMAT: date-time)''' ELSE 'string' END", "concat(column_name, ': ', t)", "", "", "\\n")


@query("schema_fields", f"""SELECT table_name, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'number' WHEN data_type = 'FLOAT[]' THEN 'array' ELSE 'string' END AS type,
  FALSE AS required, CAST(column_index - 1 AS INTEGER) AS place FROM duckdb_columns() WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})""")
def schema_fields(spark: SparkSession, d: str) -> DataFrame:
    return catalog_fields(tables_catalog(spark, d)).select("table_name", "name", "type", "required", "place")


ORIGINAL, SIMPLE = "concat('{\"name\": \"', p_name, '\", \"brand\": \"', p_brand, '\", \"size\": ', p_size, '}')", "concat(p_name, ' ', p_brand, ' ', p_size)"


@query("compare_tokens", f"""SELECT p_partkey, a AS original_tokens, b AS simplified_tokens, a - b AS tokens_saved, round(100.0::DOUBLE * (a - b) / a, 2) AS reduction_percent FROM (
  SELECT p_partkey, CAST(len(regexp_extract_all({ORIGINAL}, '{PATTERN}')) AS BIGINT) AS a, CAST(len(regexp_extract_all({SIMPLE}, '{PATTERN}')) AS BIGINT) AS b FROM part)""")
def compare_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", comparison(F.expr(ORIGINAL), F.expr(SIMPLE)).alias("c")).select("p_partkey", "c.*")


ORDER = Signature({"o_orderkey": int, "o_orderpriority": str}, {"key": int, "status": str})


@query("adapter_prompt", """SELECT o_orderkey, concat('[[ ## o_orderkey ## ]]', chr(10), o_orderkey, chr(10), chr(10), '[[ ## o_orderpriority ## ]]', chr(10), o_orderpriority, chr(10), chr(10),
  'Respond with a JSON object in the following order of fields: `key` (must be formatted as a valid Python int), then `status`.') AS prompt FROM orders""")
def adapter_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", user_message(ORDER).alias("prompt"))


@query("adapter_parse_completion", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS key, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Missing fields: status' END AS error FROM orders""")
def adapter_parse_completion(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('Sure! ```json', chr(10), '{\"key\": ', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', \"status\": \"', o_orderstatus, '\"') END, ', \"extra\": 1}', chr(10), '``` Bye')"
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(text).alias("t"))
    return parse_completions(rows, "t", ORDER).select("o_orderkey", "fields.key", "fields.status", "error")


@query("adapter_invalid_cast", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS key, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'done' END END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'Invalid fields: key' ELSE 'Invalid fields: key, kind' END END AS error FROM orders""")
def adapter_invalid_cast(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('{\"key\": ', CASE WHEN o_orderkey % 3 = 0 THEN '\"abc\"' ELSE CAST(o_orderkey AS STRING) END, ', \"kind\": \"', CASE WHEN o_orderkey % 2 = 0 THEN 'open' WHEN o_orderkey % 3 = 0 THEN 'lost' ELSE 'done' END, '\"}')"
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(text).alias("t"))
    return parse_completions(rows, "t", Signature({}, {"key": int, "kind": Literal["open", "done"]})).select("o_orderkey", "fields.key", "fields.kind", "error")


@query("adapter_yaml_completion", "SELECT n_nationkey, n_name AS name, n_regionkey AS region, CAST(NULL AS VARCHAR) AS error FROM nation")
def adapter_yaml_completion(spark: SparkSession, d: str) -> DataFrame:
    text = f"CASE WHEN n_nationkey % 2 = 0 THEN {PLAIN} ELSE concat('{{\"name\": \"', n_name, '\", \"region\": ', n_regionkey, ',}}') END"
    rows = table(spark, d, "nation").select("n_nationkey", F.expr(text).alias("t"))
    return parse_completions(rows, "t", Signature({}, {"name": str, "region": int}), mode="yaml").select("n_nationkey", "fields.name", F.col("fields.region").cast("int").alias("region"), "error")


@query("adapter_assistant_message", """SELECT n_nationkey, concat('{', chr(10), '  "name": "', n_name, '",', chr(10), '  "region": ', n_regionkey, chr(10), '}') AS jsonish, concat('name: ', n_name, chr(10), 'region: ', n_regionkey) AS yaml FROM nation""")
def adapter_assistant_message(spark: SparkSession, d: str) -> DataFrame:
    values, sign = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), Signature({}, {"name": str, "region": int})
    return table(spark, d, "nation").select("n_nationkey", *[assistant_message(values, sign, m).alias(m) for m in ("jsonish", "yaml")])


@query("token_reduction")
def token_reduction(spark: SparkSession, d: str) -> DataFrame:
    """What each rendering of the tables' schemas saves over their JSON text."""
    schemas = tables_catalog(spark, d)
    each = [compare_catalog(schemas, f).select("table_name", F.lit(f).alias("format"), "tokens.*") for f in ("jsonish", "typescript", "yaml")]
    return each[0].union(each[1]).union(each[2])


@query("sql_loads_yaml", """SELECT n_nationkey, concat('{"name": "', n_name, '"}') AS loaded FROM nation""")
def sql_loads_yaml(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    table(spark, d, "nation").createOrReplaceTempView("tessella_nation")
    return spark.sql("SELECT n_nationkey, loads_yaml(concat('name: ', n_name)) AS loaded FROM tessella_nation")


@query("sql_functions", """SELECT n_nationkey, concat('{"name": "', n_name, '"}') AS loaded, n_regionkey < 3 AS is_valid, CAST(len(regexp_extract_all(n_name, ' ?[A-Za-z]+| ?[0-9]+| ?[^\\sA-Za-z0-9]+|\\s+')) AS BIGINT) AS tokens FROM nation""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    table(spark, d, "nation").createOrReplaceTempView("tessella_nation")
    return spark.sql(r"""SELECT n_nationkey, loads_json(concat('say {"name": "', n_name, '",} now')) AS loaded,
      validate_json('{"properties": {"r": {"exclusiveMaximum": 3}}}', concat('{"r": ', n_regionkey, '}')).is_valid AS is_valid, token_count(n_name) AS tokens FROM tessella_nation""")
