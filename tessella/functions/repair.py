"""Payloads out of text, in Python: a tolerant JSON reader and the steps by which YAML is found and mended.

Columns use these for rows that the built-in expressions can't read; the calls on single values use them as they are.
"""

from __future__ import annotations

import json
import re
from typing import Any

import yaml

from tessella.errors import ConversionError

JSON_FENCE = re.compile(r"```json(.*?)```", re.DOTALL)
YAML_FENCE = re.compile(r"```ya?ml(.*?)```", re.DOTALL)
# A line that begins with one of these words is prose, not YAML.
PROSE = ("the", "here", "this", "that", "configuration", "data", "result")
PROSE_LINE = re.compile(rf"(?:{'|'.join(PROSE)}) [^:]*", re.IGNORECASE)
ENTRY = re.compile(r"\s*(?:-[ ]\s*\S|(?=[-_]*[^\W_])[\w-]+\s*:)")  # a list item, or a key of letters, digits, _ and -


def loads(text: str, mode: str = "json", repair: bool = True) -> Any:
    """The value that a messy text holds."""
    if mode not in ("json", "yaml"):
        raise ConversionError(f"Unsupported mode: {mode}. Use 'json' or 'yaml'")
    if not isinstance(text, str) or not text.strip():
        raise ConversionError("Empty or whitespace-only text")
    return loads_json(text.strip(), repair) if mode == "json" else loads_yaml(text.strip(), repair)


def loads_json(text: str, repair: bool = True, compat: bool = False) -> Any:
    fence = JSON_FENCE.search(text)
    return parse_json(fence[1].strip() if fence else embedded_json(text, compat).strip(), repair)


def embedded_json(text: str, compat: bool = False) -> str:
    """The whole text if it is JSON, else its first object, else its first array, else the longest candidate, else the text."""
    if _valid(text):
        return text
    for open_, close in ("{}", "[]"):
        got = balanced(text, open_, close, compat)
        if got and got != text:
            return got
    spans = sorted((t[0] - t[1], t) for kind in ("{}", "[]") for t in flat_spans(text, *kind) if t[1] - t[0] >= 0.8 * len(text))
    return next((text[i:j] for _, (i, j) in spans if _valid(text[i:j])), text)


def flat_spans(text: str, open_: str, close: str) -> list[tuple[int, int]]:
    """Spans of brackets that hold at most one level of the same brackets, in one pass."""
    out, stack = [], []  # a span's start and the levels within it
    for m in re.finditer(f"[{re.escape(open_ + close)}]", text):
        if m[0] == open_:
            stack.append([m.start(), 0])
        elif stack:
            start, levels = stack.pop()
            if levels <= 1:
                out.append((start, m.end()))
            if stack:
                stack[-1][1] = max(stack[-1][1], levels + 1)
    return out


def balanced(text: str, open_: str, close: str, compat: bool = False) -> str | None:
    """From the first open bracket to its close. Brackets in strings don't count, unless compat."""
    start = text.find(open_)
    if start < 0:
        return None
    depth = 0
    for m in (re.finditer(f"[{re.escape(open_ + close)}]", text[start:]) if compat else re.finditer(rf'"(?:[^"\\]++|\\(?:.|$))*+(?:"|$)|[{re.escape(open_ + close)}]', text[start:], re.DOTALL)):
        depth += (m[0] == open_) - (m[0] == close)
        if not depth:
            return text[start : start + m.end()]
    return None


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def parse_json(text: str, repair: bool = True) -> Any:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        if not repair:
            raise ConversionError(f"Failed to parse JSON: {text[:100]}...") from None
    try:
        return Tolerant(text).read()
    except (ValueError, IndexError, RecursionError):
        raise ConversionError(f"Failed to parse JSON: {text[:100]}...") from None


class Tolerant:
    """Reads JSON with trailing or missing commas, any quotes, bare keys and words, comments, Python's literals, and an end that is cut off."""

    WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "undefined": None, "NaN": float("nan"), "Infinity": float("inf")}
    QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
    NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
    SPACE = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|$))+", re.DOTALL)
    BARE = re.compile(r"[^\s,:{}\[\]\"']+")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def read(self) -> Any:
        for i, c in enumerate(self.text):
            if c in "{[":
                self.at = i
                return self.value()
        self.skip()
        out = self.value()
        self.skip()
        if self.at < len(self.text):
            raise ValueError("text after the value")
        return out

    def skip(self) -> str:
        m = self.SPACE.match(self.text, self.at)
        if m:
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self, ends: str = ",}]") -> Any:
        c = self.skip()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in self.QUOTES and c:
            return self.string(ends)
        m = self.NUMBER.match(self.text, self.at)
        if m and self.text[m.end() : m.end() + 1] in ("", *" \n\r\t,}]:/#"):
            self.at = m.end()
            raw = m[0].lstrip("+")
            return float(raw) if re.search("[.eE]", raw) else int(raw)
        stop = re.compile(rf"[\n{re.escape(ends)}]").search(self.text, self.at)
        word = self.text[self.at : stop.start() if stop else len(self.text)].strip()
        if not word:
            raise ValueError("no value")
        self.at += len(self.text[self.at : stop.start()]) if stop else len(self.text) - self.at
        return self.WORDS[word] if word in self.WORDS else word

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while True:
            c = self.skip()
            if c in ("", "}", "]"):
                self.at += c == "}"
                return out
            if c in ",;":
                self.at += 1
                continue
            if c in self.QUOTES:
                key = self.string(":")
            else:
                m = self.BARE.match(self.text, self.at)
                if not m:
                    raise ValueError("no key")
                key, self.at = m[0], m.end()
            c = self.skip()
            if c in ":=":
                self.at += bool(c)
            if self.skip() in ("", ",", "}"):
                out[key] = None if c else ""
                continue
            out[key] = self.value(",}")

    def array(self) -> list:
        self.at += 1
        out: list = []
        while True:
            c = self.skip()
            if c in ("", "]", "}"):
                self.at += c == "]"
                return out
            if c in ",;":
                self.at += 1
                continue
            out.append(self.value(",]"))

    def string(self, ends: str) -> str:
        """To the quote that closes it: one behind which stands what may follow, or the end of the text."""
        quote = self.QUOTES[self.text[self.at]]
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                n = self.text[self.at + 1]
                if n == "u" and re.match("[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(n, n))
                self.at += 2
                continue
            if c == quote:
                after = self.text[self.at + 1 :].lstrip()[:1]
                if after in ("", *",:}]\"'/#", *ends) or "\n" in self.text[self.at + 1 : self.at + 3]:
                    self.at += 1
                    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            out.append(c)
            self.at += 1
        return "".join(out)


def loads_yaml(text: str, repair: bool = True) -> dict:
    fence = YAML_FENCE.search(text)
    return parse_yaml(fence[1].strip("\n").rstrip() if fence else embedded_yaml(text), repair)


def embedded_yaml(text: str) -> str:
    """From the first entry to the last one before a line of prose; all of it if there is no entry."""
    lines, first, last = text.split("\n"), None, 0
    for i, line in enumerate(lines):
        if ENTRY.match(line):
            first, last = (i if first is None else first), i
        elif first is not None and PROSE_LINE.fullmatch(line):
            break
    return text if first is None else "\n".join(lines[first : last + 1])


def parse_yaml(text: str, repair: bool = True) -> dict:
    try:
        return _mapping(text)
    except yaml.YAMLError:
        if not repair:
            raise ConversionError(f"Failed to parse YAML: {text[:100]}...") from None
    lines = [x for x in text.split("\n") if x.strip()]
    indent = min((len(x) - len(x.lstrip()) for x in lines), default=0)
    start = next((i for i, x in enumerate(lines) if ":" in x), len(lines))
    for part in ([x[indent:] for x in lines], lines[start:], [x.strip() for x in lines if ":" in x]):
        try:
            got = yaml.safe_load("\n".join(part))
        except yaml.YAMLError:
            continue
        if isinstance(got, dict):
            return got
    try:
        got = loads_json(text, True)
    except ConversionError:
        got = None
    if isinstance(got, dict):
        return got
    raise ConversionError(f"Failed to parse YAML: {text[:100]}...")


def _mapping(text: str) -> dict:
    got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ConversionError(f"YAML content must be a dictionary/object, got {type(got).__name__}")
    return got


def dumps(value: Any) -> str:
    """JSON text that Spark's parser takes: dates become text, numbers that JSON lacks null."""

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            return {k if isinstance(k, str) else json.dumps(k) if isinstance(k, (bool, int, float)) or k is None else str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [clean(v) for v in x]
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        return x if x is None or isinstance(x, (str, int, float, bool)) else x.isoformat() if hasattr(x, "isoformat") else str(x)

    return json.dumps(clean(value), ensure_ascii=False)
