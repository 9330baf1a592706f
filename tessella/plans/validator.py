"""A JSON Schema compiled to one boolean expression on a VARIANT, and the column that adds messages.

Rows that hold never leave the expression. Only those that fail go to the interpreter, which words the messages. A schema
that no expression can express is interpreted for all rows.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import ValidationError
from tessella.functions.extract import extract_json, spare, strict, strip
from tessella.functions.interpret import Interpreter, describe, parse_data, which
from tessella.sources.schemas import to_schema

MOST_NODES = 400  # schemas with more parts are interpreted: their expressions would be too large to compile
RESULT = "struct<is_valid: boolean, errors: array<string>>"


class Inexpressible(Exception):
    pass


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class Compiler:
    """Every method gives an expression that is true or false, never null."""

    def __init__(self, source: Any):
        self.walker = Interpreter(source)
        self.nodes = 0

    def compile(self, v: Column) -> Column:
        return self.holds(self.walker.root, v, ())

    def holds(self, s: Any, v: Column, open_: tuple) -> Column:
        if s is True or s is False or not isinstance(s, dict):
            return F.lit(s is not False)
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise Inexpressible("too many parts")
        t = Kinds(v)
        out = []
        for k, x in s.items():
            if k in ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef"):
                raise Inexpressible(k)
            rule = getattr(self, f"k_{k.lstrip('$')}", None)
            if rule:
                out.append(F.coalesce(rule(x, s, v, t, open_), F.lit(False)))
        return all_of(out)

    def k_ref(self, x, s, v, t, open_):
        if x in open_ or (target := self.walker.resolve(x)) is None:
            raise Inexpressible(f"reference {x}")
        return self.holds(target, v, (*open_, x))

    def k_type(self, x, s, v, t, open_):
        return any_of([t.of(n) for n in ([x] if isinstance(x, str) else x)])

    def k_properties(self, x, s, v, t, open_):
        parts = []
        for k, sub in x.items():
            p = prop(v, k)
            parts.append(p.isNull() | self.holds(sub, p, open_))
        return ~t.object | all_of(parts)

    def k_required(self, x, s, v, t, open_):
        return ~t.object | all_of([prop(v, k).isNotNull() for k in x])

    def k_enum(self, x, s, v, t, open_):
        return any_of([equals(v, t, e) for e in x])

    def k_const(self, x, s, v, t, open_):
        return equals(v, t, x)

    def k_minimum(self, x, s, v, t, open_):
        return ~t.number | t.compared(x, ">=")

    def k_maximum(self, x, s, v, t, open_):
        return ~t.number | t.compared(x, "<=")

    def k_exclusiveMinimum(self, x, s, v, t, open_):  # noqa: N802
        return ~t.number | t.compared(x, ">")

    def k_exclusiveMaximum(self, x, s, v, t, open_):  # noqa: N802
        return ~t.number | t.compared(x, "<")

    def k_multipleOf(self, x, s, v, t, open_):  # noqa: N802
        q = t.value / F.lit(float(x))
        whole = F.try_variant_get(v, "$", "bigint")
        if not isinstance(x, int):
            return ~t.number | (q == F.rint(q))
        large = t.large % F.lit(x).cast("decimal(38,0)") == 0 if x < 10**37 else F.lit(False)
        return ~t.number | F.when(t.kind == "BIGINT", whole % F.lit(x) == 0 if x < 1 << 63 else whole == 0).when(t.is_large, large).otherwise(q == F.rint(q))

    def k_minLength(self, x, s, v, t, open_):  # noqa: N802
        return ~t.string | (F.char_length(t.text) >= x)

    def k_maxLength(self, x, s, v, t, open_):  # noqa: N802
        return ~t.string | (F.char_length(t.text) <= x)

    def k_pattern(self, x, s, v, t, open_):
        return ~t.string | t.text.rlike(portable(x))

    def k_format(self, x, s, v, t, open_):
        if x in ("email", "idn-email"):
            ok = t.text.contains("@")
        elif x == "ipv4":
            part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
            ok = t.text.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
        elif x == "date":
            ok = F.when(t.text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(t.text, "yyyy-MM-dd").isNotNull() & ~t.text.startswith("0000")).otherwise(F.lit(False))
        elif x in ("time", "ipv6", "regex", "uuid"):
            raise Inexpressible(f"format {x}")
        else:
            return F.lit(True)
        return ~t.string | ok

    def k_prefixItems(self, x, s, v, t, open_):  # noqa: N802
        parts = []
        for i, sub in enumerate(x):
            e = F.try_variant_get(v, f"$[{i}]", "variant")
            parts.append(e.isNull() | self.holds(sub, e, open_))
        return ~t.array | all_of(parts)

    def k_items(self, x, s, v, t, open_):
        n = len(s.get("prefixItems", ()))
        if isinstance(x, list):
            return F.lit(True)
        rest = F.slice(t.items, n + 1, F.greatest(F.size(t.items), F.lit(1))) if n else t.items
        return ~t.array | F.forall(rest, lambda e: self.holds(x, e, open_))

    def k_minItems(self, x, s, v, t, open_):  # noqa: N802
        return ~t.array | (F.size(t.items) >= x)

    def k_maxItems(self, x, s, v, t, open_):  # noqa: N802
        return ~t.array | (F.size(t.items) <= x)

    def k_uniqueItems(self, x, s, v, t, open_):  # noqa: N802
        if not x:
            return F.lit(True)
        canonical = F.transform(t.items, lambda e: Kinds(e).canonical)
        return ~t.array | (F.size(F.array_distinct(canonical)) == F.size(t.items))

    def k_contains(self, x, s, v, t, open_):
        n = F.size(F.filter(t.items, lambda e: self.holds(x, e, open_)))
        ok = n >= s.get("minContains", 1)
        return ~t.array | (ok & (n <= s["maxContains"]) if "maxContains" in s else ok)

    def k_minProperties(self, x, s, v, t, open_):  # noqa: N802
        return ~t.object | (F.size(t.keys) >= x)

    def k_maxProperties(self, x, s, v, t, open_):  # noqa: N802
        return ~t.object | (F.size(t.keys) <= x)

    def k_patternProperties(self, x, s, v, t, open_):  # noqa: N802
        def part(p: str, sub: Any) -> Column:
            return F.forall(F.map_entries(t.map), lambda e: ~e["key"].rlike(portable(p)) | self.holds(sub, e["value"], open_))

        return ~t.object | all_of([part(p, sub) for p, sub in x.items()])

    def k_additionalProperties(self, x, s, v, t, open_):  # noqa: N802
        if x is True:
            return F.lit(True)
        names = list(s.get("properties", {}))

        def known(k: Column) -> Column:
            return (k.isin(names) if names else F.lit(False)) | any_of([k.rlike(portable(p)) for p in s.get("patternProperties", {})])

        return ~t.object | F.forall(F.map_entries(t.map), lambda e: known(e["key"]) | self.holds(x, e["value"], open_))

    def k_propertyNames(self, x, s, v, t, open_):  # noqa: N802
        if not isinstance(x, dict):
            return ~t.object | (F.size(t.keys) == 0) if x is False else F.lit(True)
        if set(x) - {"pattern", "minLength", "maxLength", "type", "title", "description"} or x.get("type", "string") != "string":
            raise Inexpressible("propertyNames")
        tests = ([lambda k: k.rlike(portable(x["pattern"]))] if "pattern" in x else []) + ([lambda k: F.char_length(k) >= x["minLength"]] if "minLength" in x else []) + ([lambda k: F.char_length(k) <= x["maxLength"]] if "maxLength" in x else [])
        return ~t.object | F.forall(t.keys, lambda k: all_of([f(k) for f in tests]))

    def k_dependentRequired(self, x, s, v, t, open_):  # noqa: N802
        return ~t.object | all_of([prop(v, k).isNull() | all_of([prop(v, n).isNotNull() for n in needs]) for k, needs in x.items()])

    def k_dependentSchemas(self, x, s, v, t, open_):  # noqa: N802
        return ~t.object | all_of([prop(v, k).isNull() | self.holds(sub, v, open_) for k, sub in x.items()])

    def k_allOf(self, x, s, v, t, open_):  # noqa: N802
        return all_of([self.holds(sub, v, open_) for sub in x])

    def k_anyOf(self, x, s, v, t, open_):  # noqa: N802
        return any_of([self.holds(sub, v, open_) for sub in x])

    def k_oneOf(self, x, s, v, t, open_):  # noqa: N802
        return reduce(lambda a, b: a + b, [self.holds(sub, v, open_).cast("int") for sub in x]) == 1

    def k_not(self, x, s, v, t, open_):
        return ~self.holds(x, v, open_)

    def k_if(self, x, s, v, t, open_):
        return F.when(self.holds(x, v, open_), self.holds(s.get("then", True), v, open_)).otherwise(self.holds(s.get("else", True), v, open_))


class Kinds:
    """Tests of a VARIANT's type, and its value as each."""

    def __init__(self, v: Column, kind: Column | None = None):
        self.v, self.kind = v, F.schema_of_variant(v) if kind is None else kind
        self.object, self.array, self.string = self.kind.startswith("OBJECT"), self.kind.startswith("ARRAY"), self.kind == "STRING"
        self.number = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        self.value = F.try_variant_get(v, "$", "double")
        self.whole = F.try_variant_get(v, "$", "bigint")
        self.large, self.is_large = F.try_variant_get(v, "$", "decimal(38,0)"), self.kind.rlike(r"^DECIMAL\([0-9]+,0\)")  # integers beyond BIGINT
        self.text = F.try_variant_get(v, "$", "string")
        self.items = F.try_variant_get(v, "$", "array<variant>")
        self.map = F.try_variant_get(v, "$", "map<string,variant>")
        self.keys = F.map_keys(self.map)

    @property
    def canonical(self) -> Column:
        """A text that equal values share."""
        whole = (self.value == F.rint(self.value)) & (F.abs(self.value) < 1e37)
        return F.when(self.number, F.when(whole, self.large.cast("string")).otherwise(self.value.cast("string"))).otherwise(F.to_json(self.v))

    def compared(self, x: float, sign: str) -> Column:
        """The number against x, exactly: integers as integers, others as doubles against the doubles next to x."""
        below, above = (math.floor(x), math.ceil(x)) if math.isfinite(x) else (x, x)
        whole = {">=": lambda: _against(self.whole, above, sign), "<": lambda: _against(self.whole, above, sign), "<=": lambda: _against(self.whole, below, sign), ">": lambda: _against(self.whole, below, sign)}[sign]()
        near = float(x) if abs(x) < 1e300 else math.copysign(1e300, x)
        if sign in (">=", "<"):  # the least double that isn't below x
            near = near if near >= x else math.nextafter(near, math.inf)
        else:
            near = near if near <= x else math.nextafter(near, -math.inf)
        other = {">=": self.value >= near, ">": self.value > near, "<=": self.value <= near, "<": self.value < near}[sign]
        end = above if sign in (">=", "<") else below
        large = _against(self.large, end, sign, 10**38 - 1, "decimal(38,0)")
        return F.when(self.kind == "BIGINT", whole).when(self.is_large, large).otherwise(other)

    def of(self, t: str) -> Column:
        if t == "integer":
            return self.number & ((self.kind == "BIGINT") | (self.value == F.rint(self.value)))
        return {"object": self.object, "array": self.array, "string": self.string, "number": self.number, "boolean": self.kind == "BOOLEAN", "null": self.kind == "VOID"}[t]


def _against(c: Column, x: int, sign: str, most: int = 1 << 63, kind: str = "bigint") -> Column:
    """A column of integers of that kind, below `most`, against an integer of any size."""
    if not -most <= x < most:
        return F.lit((x > 0) == sign.startswith("<"))
    n = F.lit(str(x)).cast(kind)
    return {">=": c >= n, ">": c > n, "<=": c <= n, "<": c < n}[sign]


def prop(v: Column, key: str) -> Column:
    """The VARIANT of a property, null where there is none; a JSON null is one."""
    if '"' in key and "'" in key or "\\" in key:
        raise Inexpressible(f"key {key}")
    return F.try_variant_get(v, f"$['{key}']" if '"' in key else f'$["{key}"]', "variant")


def equals(v: Column, t: Kinds, x: Any) -> Column:
    if isinstance(x, bool):
        return (t.kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == x)
    if x is None:
        return t.kind == "VOID"
    if isinstance(x, (int, float)):
        return t.number & t.compared(x, ">=") & t.compared(x, "<=")
    if isinstance(x, str):
        return t.string & (t.text == x)
    if re.search(r"[0-9]\.|[eE][+-]?[0-9]", json.dumps(x)):
        raise Inexpressible("a container of fractions")
    return F.to_json(v) == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# What Python's classes hold, in Java's words. Inside a bracket, the negated ones can't be said.
CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"}


def portable(p: str) -> str:
    """A Python pattern that means the same to Java."""
    out, i, inside = ["(?d)"], 0, False  # only \n ends a line
    while i < len(p):
        c = p[i]
        if c == "\\":
            n = p[i + 1]
            if n.lower() in CLASSES:
                if n.isupper() and inside:
                    raise Inexpressible(f"pattern {p}")
                out.append(CLASSES[n] if inside else f"[{'^' * n.isupper()}{CLASSES[n.lower()]}]")
            elif n.isalnum() and n not in "ntrfx" and not (n == "A" and not inside) and not (n in "123456789" and not inside and not p[i + 2 : i + 3].isdigit()):
                raise Inexpressible(f"pattern {p}")
            else:
                out.append(p[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "[" or p.startswith("&&", i):
                raise Inexpressible(f"pattern {p}")
            inside = c != "]"
        elif c == "[":
            inside = True
            if re.match(r"\[\^?\]", p[i:]):
                raise Inexpressible(f"pattern {p}")
        elif p.startswith("(?", i) and p[i + 2 : i + 3] not in (":", "=", "!") and p[i + 2 : i + 4] not in ("<=", "<!") or p.startswith("{,", i):
            raise Inexpressible(f"pattern {p}")
        out.append(c)
        i += 1
    return "".join(out)


def is_valid(source: Any, v: Column) -> Column:
    """Whether a VARIANT holds under the schema. Raises Inexpressible where no expression can say."""
    return Compiler(source).compile(v)


def _interpreted(source: Any, mode: str, first_only: bool):
    schema = to_schema(source)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        walker, ok, errors = Interpreter(schema), [], []
        for text in texts:
            found = [] if text is None else [describe(f) for f in walker.failures(parse_data(text, which(text, mode)))]
            ok.append(None if text is None else not found)
            errors.append((found[:1] if first_only else found) or None)
        return pd.DataFrame({"is_valid": pd.Series(ok, dtype="object"), "errors": pd.Series(errors, dtype="object")})

    return run.asNondeterministic()  # so that a filter on the result stays above: below, it would copy this call and its input


def validate(df: DataFrame, column: str, source: Any, output: str = "validation", mode: str = "auto", first_only: bool = False) -> DataFrame:
    """df with struct<is_valid, errors> of a text column; errors is null where it holds, the struct where the text is."""
    if mode not in ("auto", "json", "yaml"):
        raise ValidationError(f"Unsupported mode: {mode}. Use 'auto', 'json' or 'yaml'")
    run, c = _interpreted(source, mode, first_only), F.col(column)
    Interpreter(source)
    value_, fast, slow = spare(df, "__value", "__fast", "__slow")
    looks = strip(c).rlike(r"\A[\{\[]")
    try:
        if mode == "yaml":
            raise Inexpressible("YAML")
        # numbers that no BIGINT holds are the interpreter's
        parsed = strict(F.when(looks & ~c.rlike("[0-9]{19}|[0-9][eE][+]?[0-9]{2}"), extract_json(c, all_=False)))
        # in JSON mode, a text that doesn't look like JSON is the value itself
        value = parsed if mode == "auto" else F.when(looks, parsed).otherwise(F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("s")))), "$.s", "variant"))
        v = F.col(value_)
        holds = F.coalesce(v.isNotNull() & is_valid(source, v), F.lit(False))
        rows = df.withColumn(value_, value).withColumn(fast, holds).drop(value_)
    except Inexpressible:
        rows = df.withColumn(fast, F.lit(False))
    rows = rows.withColumn(slow, run(F.when(~F.col(fast), c)))  # rows that hold cross as nulls
    result = F.struct((F.col(fast) | F.coalesce(F.col(f"{slow}.is_valid"), F.lit(False))).alias("is_valid"), F.when(~F.col(fast), F.col(f"{slow}.errors")).alias("errors"))
    return rows.withColumn(output, F.when(c.isNotNull(), result)).drop(fast, slow)
