"""Payloads out of text columns. Strict JSON stays in built-in expressions; only rows that they can't read reach Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import ConversionError

from . import repair as R

FENCE = r"(?s)```json(.*?)```"
# What Python's strip() takes off.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STRING = r'"(?:[^"\\]++|\\.)*+"'
FLAT_LENGTH = 2000  # longer texts are not given to a pattern that repeats groups
RESULT = "struct<json: string, error: string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def strict(c: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else null.

    Spark's parser ignores what follows a value. Inside an array and inside an object nothing can follow unseen.
    """
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return let(listed, lambda x: F.when(F.try_variant_get(x, "$[1]", "variant").isNull() & keyed, F.try_variant_get(x, "$[0]", "variant")))


def balanced(c: Column, open_: str, close: str, compat: bool = False, all_: bool = True) -> Column:
    """From the first open bracket to its close, or null. A bracket in a string doesn't count, unless compat. Null too, unless all_, where the pattern can't tell."""
    o, k = f"\\{open_}", f"\\{close}"
    inner = f"[^{o}{k}]*+" if compat else f'(?:[^{o}{k}"]++|{STRING})*+'
    quick = let(F.regexp_extract(c, f"(?s)^[^{o}]*({o}{inner}{k})", 1), lambda x: F.when(x != "", x))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"))

    def step(s: Column, x: Column) -> Column:
        live = (s["end"] == 0) & ~s["inside"]
        opens, closes = live & (x == open_), live & (x == close) & (s["depth"] > 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        started = s["start"] > 0
        inside = F.when(s["inside"], (x != '"') | s["escaped"]).otherwise(started & (x == '"')) if not compat else F.lit(False)
        return F.struct(
            (s["at"] + 1).alias("at"), depth.alias("depth"), F.when(opens & ~started, s["at"] + 1).otherwise(s["start"]).alias("start"),
            F.when(closes & (depth == 0), s["at"] + 1).otherwise(s["end"]).alias("end"), inside.alias("inside"), (s["inside"] & (x == "\\") & ~s["escaped"]).alias("escaped"),
        )

    fold = F.aggregate(F.split(c, ""), zero, step, lambda s: F.when(s["end"] > 0, c.substr(s["start"], s["end"] - s["start"] + 1)))
    short = F.when(F.length(c) <= FLAT_LENGTH, quick)  # in a branch of its own, so that it isn't computed for others
    return F.when(c.contains(open_), F.coalesce(short, fold) if all_ else short)


def embedded_json(c: Column, compat: bool = False, all_: bool = True) -> Column:
    """The text of the JSON value in c: all of it if it is one, else the first object, else the first array, else all. (Other candidates are the reader's.)"""
    part = lambda o, k, rest: let(balanced(c, o, k, compat, all_), lambda x: F.when(x.isNotNull() & (x != c), x).otherwise(rest))
    array = F.when(F.length(c) <= FLAT_LENGTH, part("[", "]", c)).otherwise(c) if not all_ else part("[", "]", c)
    opened = c.contains("{") & balanced(c, "{", "}", compat, all_).isNull() if not all_ else F.lit(False)
    return F.when(strict(c).isNotNull() | opened, c).otherwise(part("{", "}", array))


def extract_json(c: Column, compat: bool = False, all_: bool = True) -> Column:
    """The text between the first json fence, else what embedded_json() finds; stripped."""
    return let(strip(c), lambda s: strip(F.when(s.rlike(FENCE), F.regexp_extract(s, FENCE, 1)).otherwise(embedded_json(s, compat, all_))))


def mended(c: Column) -> Column:
    """c without commas that nothing follows, outside strings; null for long texts."""
    return F.when(F.length(c) <= FLAT_LENGTH, F.regexp_replace(c, rf"({STRING})|,(?=\s*[}}\]])", "$1"))


def _udf(read: Callable[[str], object]) -> Callable[[Column], Column]:
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        json_, errors = [], []
        for t in texts:
            value = error = None
            if t is not None:
                try:
                    value = R.dumps(read(t))
                except ConversionError as e:
                    error = str(e)
            json_.append(value)
            errors.append(error)
        return pd.DataFrame({"json": pd.Series(json_, dtype="object"), "error": pd.Series(errors, dtype="object")})

    return run.asNondeterministic()  # so that a filter on the result stays above: below, it would copy this call and its input


def loads(df: DataFrame, column: str, output: str = "loaded", mode: str = "json", repair: bool = True, compat: bool = False) -> DataFrame:
    """df with struct<value: variant, error: string> of what a text column holds; value is null where error isn't.

    What strict JSON reads is one projection; the Python reader gets nulls for those rows.
    """
    if mode not in ("json", "yaml"):
        raise ConversionError(f"Unsupported mode: {mode}. Use 'json' or 'yaml'")
    c = F.col(column)
    quick, slow = spare(df, "__read", "__slow")
    error = F.col(f"{slow}.error")
    blank = F.when(c.isNull() | (strip(c) == ""), F.lit("Empty or whitespace-only text"))
    if mode == "yaml":
        rows = df.withColumn(slow, _udf(lambda t: R.loads_yaml(t, repair))(F.when(blank.isNull(), strip(c))))
        return rows.withColumn(output, F.struct(F.parse_json(f"{slow}.json").alias("value"), F.coalesce(blank, error).alias("error"))).drop(slow)
    parsed = lambda t: F.coalesce(strict(t), strict(mended(t))) if repair else strict(t)
    rows = df.withColumn(quick, let(extract_json(c, compat, False), parsed))
    rows = rows.withColumn(slow, _udf(lambda t: R.loads_json(t, repair, compat))(F.when(F.col(quick).isNull() & blank.isNull(), strip(c))))
    value = F.coalesce(quick, F.when(blank.isNull(), F.try_parse_json(f"{slow}.json")))
    return rows.withColumn(output, F.struct(value.alias("value"), F.coalesce(blank, F.when(F.col(quick).isNull(), error)).alias("error"))).drop(quick, slow)
