"""Token counts and what a rendering saves. The tokenizer is a parameter; the default needs no vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, numbers and signs, each with the space before it: a pattern that Python, Java and RE2 read alike.
PATTERN = r" ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+"
Tokenizer = Callable[[str], int]


def default_tokenizer(text: str) -> int:
    return len(re.findall(PATTERN, text, re.ASCII))


# How public vocabularies part texts before they are encoded.
SPLITS = {
    "gpt2": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "cl100k_base": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}


def bpe(path: str, split: str | None = None) -> Tokenizer:
    """A tokenizer file of the tokenizers library, or a .tiktoken vocabulary with the pattern that parts texts (or its name in SPLITS).

    Without one, a file named after a pattern goes by that, others by gpt2's.
    """
    if path.endswith(".tiktoken"):
        return _Ranks(path, SPLITS.get(split or path.rsplit("/", 1)[-1].removesuffix(".tiktoken"), split or SPLITS["gpt2"]))
    return _File(path)


class _File:
    def __init__(self, path: str):
        self.path, self.it = path, None

    def __call__(self, text: str) -> int:
        if self.it is None:
            try:
                from tokenizers import Tokenizer as T
            except ImportError as e:
                raise ImportError("Token counts with a tokenizer file need the tokenizers library") from e
            self.it = T.from_file(self.path)
        return len(self.it.encode(text, add_special_tokens=False).ids)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "it": None}


class _Ranks(_File):
    def __init__(self, path: str, split: str):
        super().__init__(path)
        self.split = split

    def __call__(self, text: str) -> int:
        if self.it is None:
            try:
                import base64

                import tiktoken
            except ImportError as e:
                raise ImportError("Token counts with a .tiktoken vocabulary need the tiktoken library") from e
            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.it = tiktoken.Encoding("file", pat_str=self.split, mergeable_ranks=ranks, special_tokens={})
        return len(self.it.encode_ordinary(text))


def token_count(c: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Tokens of a text column: a built-in expression, or an Arrow function for a tokenizer of one's own."""
    if tokenizer is None:
        return F.regexp_count(c, F.lit(PATTERN)).cast("long")

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tokenizer(t) for t in texts], dtype="Int64")

    return run(c)


def comparison(original: Column, simplified: Column, tokenizer: Tokenizer | None = None) -> Column:
    """struct<original_tokens, simplified_tokens, tokens_saved, reduction_percent> of two text columns."""
    a, b = token_count(original, tokenizer), token_count(simplified, tokenizer)
    percent = F.when(a > 0, F.round(100.0 * (a - b) / a, 2)).otherwise(0.0)
    return F.struct(a.alias("original_tokens"), b.alias("simplified_tokens"), (a - b).alias("tokens_saved"), percent.alias("reduction_percent"))


def compare_tokens(schema: Any, simplified: str, tokenizer: Tokenizer | None = None) -> dict[str, Any]:
    """The same for one schema: its JSON text against a rendering."""
    from tessella.sources.schemas import to_schema

    count = tokenizer or default_tokenizer
    a, b = count(json.dumps(to_schema(schema))), count(simplified)
    return {"original_tokens": a, "simplified_tokens": b, "tokens_saved": a - b, "reduction_percent": round(100 * (a - b) / a, 2) if a else 0.0}
