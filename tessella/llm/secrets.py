"""Secret scans: patterns, and novelty measured by a dictionary-primed compressor.

Base spans are the matches of three fixed patterns. Beside them, a token that stands after a sensitive word is priced: the
text around it is compressed with a dictionary of identifiers and code, once with the token and once without, and the
bytes that it adds tell how much of it neither the dictionary nor its surroundings explain. A token that adds almost its
own length of bytes is reported as a `novel` span, or what base spans leave of it. The price alone decides: random letters and
digits cost their whole length and more, most words less than the rate of 0.6, but some words cost that too and are reported.

A token is a whole run of 8 characters or more (what base spans leave of it: 8 or more, to be priced), of any length; beyond 256 characters it is priced in pieces.
It starts at most 48 characters behind any sensitive word, on its line, or on the next line where nothing but signs stands between;
in a private key block, all lines up to its end are in reach. Tokens joined by '.' or '=' are one; a reported token
that ends with its line goes on in the next line where that is nothing but a token.

Defined results: a null or empty text has no spans (the sha256 of an empty string); offsets are code points, end
exclusive; repeated rows each get their own row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are whole and overlap no other, so short ones need not be matched to be dropped
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?ai:passwords?|passwd|pwd|passphrase|credentials?|secrets?|tokens?|(?:api|access|private)[\x20_-]?keys?|[a-z0-9][_-]keys?|auth(?:orization)?|bearer|session[_-]?id)")
SENSITIVE_WORDS = ("pass", "pwd", "credential", "secret", "token", "key", "auth", "bearer", "session")
WINDOW = 48  # a candidate starts that near behind a sensitive word, on its line
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
LEAST, PIECE = 8, 256  # characters of a candidate, and of what is priced at once
LINE_END = re.compile(r"[-\"':=\x20\t]*\r?\n[\x20\t]*")
BLOCK = re.compile(r"(?:\x20BLOCK)?-----[\x20\t]*\r?\n")

DICTIONARY = (
    "function return class import export default const static public private protected void string integer boolean "
    "configuration environment application database connection username hostname localhost example placeholder your_api_key_here "
    "changeme_please redacted_value undefined none_provided authentication authorization_header content-type application/json "
    "get_access_token set_password_hash refresh_token client_secret private_key_path public_key_file session_identifier "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 xxxxxxxxxxxxxxxxxxxxxxxx ************************ "
    "AAAAAAAAAAAAAAAAAAAAAAAA 00000000000000000000000000000000 1234567890123456789012345678901234567890 "
)
PROSE = (
    "When the weather improved, everybody walked slowly down through quiet streets towards some market beside a river, whose "
    "bridges have joined both halves of our city since long before anybody living could remember; merchants offered bread, "
    "apples, fresh fish and flowers, children played games, while older people just sat and explained what they had heard "
    "about the government, the new school, the price of grain and the ships that would be expected within a fortnight. "
)


class Novelty:
    """Bytes that a string adds to its surroundings under zstandard with a raw dictionary.

    Below some 64 literals zstandard stores them as they are, beyond that it codes them all. PROSE stands before both
    texts that are compared, so that both are coded and the difference is what the string adds, however short its surroundings are.
    """

    def __init__(self, dictionary: str = DICTIONARY, level: int = 3):
        primed = zstandard.ZstdCompressionDict(dictionary.encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def added(self, text: str, start: int, end: int, around: int = 128) -> int:
        before, after = text[max(0, start - around) : start], text[end : end + around]
        return self.size(PROSE + before + after + text[start:end]) - self.size(PROSE + before + after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the three patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _pieces(text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
    """What is priced of a run: the whole or, beyond PIECE characters, its parts; and what stands between signs that join."""
    n = -(-(e - s) // PIECE)
    for i in range(n):
        yield s + (e - s) * i // n, s + (e - s) * (i + 1) // n
    parts = [m.span() for m in re.finditer(r"[^=.]+", text[s:e])]
    if len(parts) > 1:
        for a, b in parts:
            for i in range(s + a, s + b, PIECE):
                yield i, min(i + PIECE, s + b)


def _left(base: list[tuple[int, int, str]], s: int, e: int) -> list[tuple[int, int]]:
    """[s, e) less the base spans."""
    out = []
    for a, _, b in base:
        if a < e and s < b:
            if s < a:
                out.append((s, a))
            s = max(s, b)
    return [*out, (s, e)] if s < e else out


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, rate: float = 0.6) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    out: list[tuple[int, int]] = []
    done = 0

    def priced(s: int, e: int, least: int = LEAST) -> bool:
        """Reports a run, or what is left of it beside the base spans, if one of its pieces is novel."""
        while s < e and text[s] in "=.":
            s += 1
        while s < e and text[e - 1] == ".":
            e -= 1
        if e - s < least:
            return False
        left = _left(base, s, e)
        if least == LEAST and not any(novelty.added(text, x, y) >= rate * (y - x) for a, b in left if b - a >= LEAST for x, y in _pieces(text, a, b) if y - x >= LEAST):
            return False
        out.extend(left)
        return True

    for near in SENSITIVE.finditer(text):
        at, stop = near.end(), near.end() + WINDOW
        line = text.find("\n", at, stop)
        stop = line if line >= 0 else min(stop, len(text))
        block = BLOCK.match(text, at) if near[0][-3:].upper() == "KEY" else None
        if block:
            end = text.find("-----END", block.end())
            at, stop = block.end(), end if end >= 0 else block.end() + 1
        elif (after := LINE_END.match(text, at)) and after.end() > done:
            at, stop = after.end(), after.end() + 1
        at = max(at, done)
        while at < stop and (m := RUN.search(text, at)) and m.start() < stop:
            s, e = m.span()
            done = at = e
            inner = text.find("=", s, e) if s == near.end() else -1  # the rest of a name, and its value
            if inner > s and text[inner:e].strip("="):
                found = priced(s, inner)
                found = priced(inner, e) or found
            else:
                found = priced(s, e, 1 if block and out and out[-1][1] <= s and LINE_END.fullmatch(text, out[-1][1], s) else LEAST)
            after = LINE_END.match(text, e) if found else None
            if after and (m := RUN.match(text, after.end())) and (m.end() == len(text) or text[m.end()] in "\r\n"):
                stop = max(stop, m.start() + 1)  # a run that ends with its line goes on where the next line is a run
    joined: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if joined and s - joined[-1][1] <= 64 and re.fullmatch(r"\r?\n[\x20\t]*", text[joined[-1][1] : s]):
            joined[-1] = (joined[-1][0], e)
        else:
            joined.append((s, e))
    return [(s, 3, e) for s, e in joined]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    for b in batches:
        cols: list[list] = [[] for _ in names[1:]]
        for x in b.column(1):
            text = x.as_py() or ""
            base = base_spans(text)
            novel = novel_spans(text, base, novelty)
            kinds = [k for _, k, _ in base]
            row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + novel)), len(novel))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel: a row for each row of docs."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
