"""Rendering queries, one for each feature of a schema: a schema for each nation, with its key at N, against the text that it must give.

The texts say what each dialect shows; both engines only put the key in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.sql import schema_render

N = "«n»"

# name: (whether with metadata, schema, JSON-like text, TypeScript-like text, YAML-like text)
CASES: dict[str, tuple[bool, str, str, str, str]] = {
    "ref": (
        True,
        '''{"type": "object", "properties": {"home": {"$ref": "#/$defs/Place"}, "work": {"$ref": "#/$defs/Place"}}, "$defs": {"Place": {"type": "object", "properties": {"code": {"type": "integer", "maximum": «n»}, "city": {"type": "string"}}, "required": ["code"]}}, "required": ["home"]}''',
        """\
// Fields marked with * are required
{
  home*: {
    code*: int (<= «n»),
    city: string
  },
  work: {
    code*: int (<= «n»),
    city: string
  }
}""",
        """\
interface Place {
  code*: number (≤«n»);
  city: string;
}

// Fields marked with * are required
interface Schema {
  home*: { code*: number (≤«n»), city: string };
  work: { code*: number (≤«n»), city: string };
}""",
        """\
# Place
Place.code*: int (<= «n»)
Place.city: string

# Fields marked with * are required

home*: '{code*: int (<= «n»), city: string}'
work: '{code*: int (<= «n»), city: string}'""",
    ),
    "ref_nested": (
        True,
        '''{"type": "object", "properties": {"p": {"$ref": "#/definitions/geo/point"}}, "definitions": {"geo": {"point": {"type": "object", "properties": {"x": {"type": "number", "minimum": «n»}}}}}}''',
        """\
{
  p: {
    x: float (>= «n»)
  }
}""",
        """\
interface Schema {
  p: { x: number (≥«n») };
}""",
        "p: '{x: float (>= «n»)}'",
    ),
    "anyof": (
        True,
        '''{"type": "object", "properties": {"v": {"anyOf": [{"type": "string", "maxLength": «n»}, {"type": "integer"}, {"type": "null"}]}}}''',
        """\
{
  v: string (<= «n» chars) OR int OR null
}""",
        """\
interface Schema {
  v: string (≤«n» chars) | number | null;
}""",
        "v: string (<= «n» chars) OR int OR null",
    ),
    "oneof": (
        True,
        '''{"type": "object", "properties": {"v": {"oneOf": [{"type": "boolean"}, {"type": "number", "maximum": «n»}]}}}''',
        """\
{
  v: ONE OF: bool OR float (<= «n»)
}""",
        """\
interface Schema {
  v: oneOf: boolean | number (≤«n»);
}""",
        "v: 'ONE OF: bool OR float (<= «n»)'",
    ),
    "allof": (
        True,
        '''{"type": "object", "properties": {"v": {"allOf": [{"type": "string", "minLength": «n»}, {"type": "string", "pattern": "^k"}]}}}''',
        """\
{
  v: string (>= «n» chars) AND string (PATTERN: ^k)
}""",
        """\
interface Schema {
  v: allOf: string (≥«n» chars) & string;
}""",
        "v: 'string (>= «n» chars) AND string (PATTERN: ^k)'",
    ),
    "not": (
        True,
        '''{"type": "object", "properties": {"v": {"type": "integer", "not": {"type": "integer", "minimum": «n»}}}}''',
        """\
{
  v: int & not int (>= «n»)
}""",
        """\
interface Schema {
  v: number & not number (≥«n»);
}""",
        "v: int & not int (>= «n»)",
    ),
    "enum_const": (
        True,
        '''{"type": "object", "properties": {"a": {"enum": ["x«n»", "y", true, null]}, "b": {"const": "c«n»"}, "c": {"const": «n»}, "d": {"enum": ["only«n»"]}}}''',
        """\
{
  a: OPTIONS: x«n»| y| true| null,
  b: c«n»,
  c: «n»,
  d: only«n»
}""",
        """\
interface Schema {
  a: x«n» | y | true | null;
  b: c«n»  // const: c«n»;
  c: «n»  // const: «n»;
  d: only«n»;
}""",
        """\
a: 'OPTIONS: x«n»| y| true| null'
b: c«n»
c: «n»
d: only«n»""",
    ),
    "scalars": (
        True,
        '''{"type": "object", "properties": {"s": {"type": "string"}, "i": {"type": "integer"}, "f": {"type": "number"}, "b": {"type": "boolean"}, "z": {"type": "null"}, "u": {"type": ["string", "null"], "default": "«n»"}, "m": {"type": ["integer", "string"]}, "a": {}}, "required": ["s", "i"]}''',
        """\
// Fields marked with * are required
{
  s*: string,
  i*: int,
  f: float,
  b: bool,
  z: null,
  u: string or null // (default='«n»'),
  m: int, string,
  a: any
}""",
        """\
// Fields marked with * are required
interface Schema {
  s*: string;
  i*: number;
  f: number;
  b: boolean;
  z: null;
  u: string | null  // (defaults to «n»);
  m: number | string;
  a: any;
}""",
        """\
# Fields marked with * are required

s*: string
i*: int
f: float
b: bool
z: 'null'
u: 'string OR null  # (default=''«n»'')'
m: int OR string
a: any""",
    ),
    "arrays": (
        True,
        '''{"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}, "minItems": «n»}, "b": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer"}}}, "maxItems": «n»}, "c": {"type": "array"}, "d": {"type": "array", "items": {"type": "integer"}, "uniqueItems": true}}}''',
        """\
{
  a: string [] (>= «n» items),
  b: [
    {
      k: int
    }
  ] // (<= «n» items),
  c: [],
  d: int [] (UNIQUE items)
}""",
        """\
interface Schema {
  a: Array<string> (length: ≥«n» items);
  b: Array<{ k: number }> (length: ≤«n» items);
  c: Array<any>;
  d: Array<number> (unique);
}""",
        """\
a: list[string] (>= «n» items)
b: 'list[{k: int}] (<= «n» items)'
c: list[Any]
d: list[int] (UNIQUE items)""",
    ),
    "nested": (
        True,
        '''{"type": "object", "properties": {"o": {"type": "object", "properties": {"p": {"type": "object", "properties": {"q": {"type": "string", "minLength": «n»}}, "required": ["q"]}}, "required": ["p"]}}}''',
        """\
{
  o: {
    p*: {
      q*: string (>= «n» chars)
    }
  }
}""",
        """\
interface Schema {
  o: { p*: { q*: string (≥«n» chars) } };
}""",
        "o: '{p*: {q*: string (>= «n» chars)}}'",
    ),
    "bounds": (
        True,
        '''{"type": "object", "properties": {"a": {"type": "string", "minLength": 1, "maxLength": «n»}, "b": {"type": "integer", "minimum": 0, "maximum": «n»}, "c": {"type": "number", "exclusiveMinimum": «n», "multipleOf": 0.5}, "d": {"type": "string", "pattern": "^k«n»", "format": "date"}}}''',
        """\
{
  a: string (1-«n» chars),
  b: int (0 to «n»),
  c: float,
  d: string (PATTERN: ^k«n») (FORMAT: date)
}""",
        """\
interface Schema {
  a: string (1-«n» chars);
  b: number (0-«n»);
  c: number  // multipleOf: 0.5, exclusiveMin: «n»;
  d: string  // pattern: ^k«n», format: date;
}""",
        """\
a: string (1-«n» chars)
b: int (0 to «n»)
c: 'float  # multipleOf: 0.5, exclusiveMin: «n»'
d: 'string (PATTERN: ^k«n») (FORMAT: date)'""",
    ),
    "additional": (
        True,
        '''{"type": "object", "properties": {"a": {"type": "integer"}}, "additionalProperties": false, "description": "d«n»"}''',
        """\
// d«n»
{
  a: int
// Root: no additional properties
}""",
        """\
// Description: d«n»
interface Schema {
  a: number;
}
 // no additional properties""",
        """\
# Description: d«n»

a: int
# no additional properties""",
    ),
    "additional_typed": (
        True,
        '''{"type": "object", "properties": {"a": {"type": "integer", "default": «n»}}, "additionalProperties": {"type": "number"}}''',
        """\
{
  a: int // (default=«n»)
// Root: additional: float
}""",
        """\
interface Schema {
  a: number  // (defaults to «n»);
}
 // additional: number""",
        """\
a: 'int  # (default=«n»)'
# additional: float""",
    ),
    "placeholder": (
        True,
        '''{"type": "object", "additionalProperties": {"type": "object", "properties": {"k": {"type": "string", "maxLength": «n»}}}}''',
        """\
{
  <key>: {
    k: string (<= «n» chars)
  }
// Root: any properties allowed
}""",
        """\
interface Schema {
  <key>: { k: string (≤«n» chars) };
}
 // any properties allowed""",
        """\
<key>:
  k: string (<= «n» chars)
# any properties allowed""",
    ),
    "schema_words": (
        True,
        '''{"type": "object", "patternProperties": {"^k«n»": {"type": "string"}}, "dependencies": {"a": ["b"]}, "if": {"type": "object", "properties": {"t": {"minimum": «n»}}}, "then": {"required": ["p"]}, "propertyNames": {"type": "string", "maxLength": «n»}, "unevaluatedProperties": false}''',
        "{}",
        """\
// Schema-level constraints: //patternProperties: ^k«n»: string //dependencies: a requires b //if t ≥ «n» then requires p //propertyNames: string (≤«n» chars) //no unevaluated properties
interface Schema {}""",
        """\
# Schema-level constraints: //patternProperties: ^k«n»: string //dependencies: a requires b //if t ≥ «n» then requires p //propertyNames: string (<= «n» chars) //no unevaluated properties
object""",
    ),
    "metadata": (
        True,
        '''{"type": "object", "properties": {"a": {"type": "string", "title": "T«n»", "description": "about a", "examples": ["e«n»"], "$comment": "c«n»"}, "b": {"type": "integer", "default": «n»}}, "title": "Doc«n»", "description": "said«n»"}''',
        """\
//Title: Doc«n»
// said«n»
{
  a: string // T«n»: about a (COMMENT: 'c«n»') (EXAMPLES: e«n»),
  b: int // (default=«n»)
}""",
        """\
// Title: Doc«n», Description: said«n»
interface Schema {
  a: string  // about a;
  b: number  // (defaults to «n»);
}""",
        """\
# Title: Doc«n», Description: said«n»

a: 'string  # T«n»: about a (COMMENT: ''c«n»'') (EXAMPLES: e«n»)'
b: 'int  # (default=«n»)'""",
    ),
    "contains": (
        True,
        '''{"type": "object", "properties": {"v": {"type": "array", "items": {"type": "string"}, "contains": {"type": "string", "enum": ["k«n»"]}}, "w": {"type": "integer"}}, "dependencies": {"w": ["v"]}}''',
        """\
{
  v: string [],
  w: int // (DEPENDS ON: v)
}""",
        """\
interface Schema {
  v: Array<string> //contains: string (k«n»)  // contains: string (k«n»);
  w: number;
}""",
        """\
v: 'list[string] //contains: string (k«n»)  # contains: string (k«n»)'
w: 'int  # (DEPENDS ON: v)'""",
    ),
    "root_array": (
        True,
        '''{"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer", "maximum": «n»}}}}''',
        """\
// Array of (items):
[
  {
    k: int (<= «n»)
  }
]""",
        "type Schema = Array<{ k: number (≤«n») }>;",
        "list[{k: int (<= «n»)}]",
    ),
    "metadata_off": (
        False,
        '''{"type": "object", "properties": {"a": {"type": "string", "title": "T«n»", "description": "about a", "examples": ["e«n»"], "$comment": "c«n»"}, "b": {"type": "integer", "default": «n»}}, "title": "Doc«n»", "description": "said«n»"}''',
        """\
{
  a: string // T«n»: about a (COMMENT: 'c«n»') (EXAMPLES: e«n»),
  b: int // (default=«n»)
}""",
        """\
interface Schema {
  a: string;
  b: number;
}""",
        """\
a: string
b: int""",
    ),
}


def rendered(name: str):
    metadata, schema, *_ = CASES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.replace(F.lit(schema), F.lit(N), F.col("n_nationkey").cast("string")).alias("s"))
        return rows.select("n_nationkey", *[schema_render("s", F.lit(f), F.lit(metadata)).alias(f) for f in ("jsonish", "typescript", "yaml")])

    return run


def sql(name: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT n_nationkey, " + ", ".join(f"replace({quoted(x)}, '{N}', CAST(n_nationkey AS VARCHAR)) AS {f}" for f, x in zip(("jsonish", "typescript", "yaml"), CASES[name][2:], strict=True)) + " FROM nation"


QUERIES = {f"render_{k}": rendered(k) for k in CASES}
SQL = {f"render_{k}": sql(k) for k in CASES}
