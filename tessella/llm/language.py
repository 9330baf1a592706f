"""Language ID by error-correcting output codes.

Each language has a codeword. For each of its bits, a logistic classifier on hashed byte n-grams (1 to 3) of the whole
text predicts the bit; the language is the one whose codeword loses least under the classifiers' margins, where a bit
weighs by how well its classifier did on the sample. A small lead over the second flags the text as ambiguous.

The classifiers learn on the driver from a sample of about `per_language` labelled rows of each language (all, if it has fewer),
chosen by a hash of doc_id and text alone; every language with a label is learned. Rows of the held-out fold
(crc32(doc_id as text) mod 4 = 2) are never sampled. Predictions see nothing but the text, all of it.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row all are; with one
language, all others are that; a null doc_id isn't held out and isn't learned from; repeated rows are predicted alike; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BITS = 13
ASCII_LETTER = re.compile("[A-Za-z]")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams, a vector of length 1."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    grams = np.concatenate((b, two + np.uint32(1 << 24), ((two[:-1] << np.uint32(8)) | b[2:]) + np.uint32(1 << 25)))
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(counts / len(grams)).astype(np.float32)


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all ways to part up to 7 of them, else the best of some random codes."""
    if n <= 7:
        columns = np.arange(1, 1 << max(0, n - 1))
        return np.array([(columns >> i & 1) if i < n - 1 else np.zeros(len(columns), int) for i in range(n)]).reshape(n, -1) * 2 - 1
    rng, best, far = np.random.default_rng(6), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(np.ceil(12 * np.log2(n)))))
        apart = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(n, dtype=int)
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart.min()
    return best


class Decoder:
    """Learned classifiers and codewords; small, as it goes to all executors."""

    def __init__(self, x: np.ndarray, labels: list[str], rounds: int = 200, decay: float = 1e-4):
        self.langs = sorted(set(labels), key=lambda s: s.encode())
        self.code = codewords(len(self.langs)).astype(np.float32) if self.langs else np.zeros((0, 0), np.float32)
        n, bits = len(labels), self.code.shape[1] if self.langs else 0
        self.w, self.weight = np.zeros((x.shape[1] if n else 1 << BITS, bits), np.float32), np.ones(bits, np.float32)
        self.bias = np.zeros(bits, np.float32)
        if not bits:
            return
        place = {s: i for i, s in enumerate(self.langs)}
        which = np.array([place[s] for s in labels])
        y = self.code[which]
        per = (1 / np.bincount(which))[which] / len(self.langs)  # each language weighs the same
        v, vb, rate = np.zeros_like(self.w), np.zeros_like(self.bias), np.float32(20.0)
        for _ in range(rounds):
            ahead, b = self.w + 0.9 * v, self.bias + 0.9 * vb
            g = (-y / (1 + np.exp(y * (x @ ahead + b))) * per[:, None]).astype(np.float32)
            v = 0.9 * v - rate * (x.T @ g + decay * ahead)
            vb = 0.9 * vb - g.sum(0)
            self.w, self.bias = self.w + v, self.bias + vb
        right = ((x @ self.w + self.bias) * y > 0).astype(np.float64)
        self.weight = np.maximum((right * per[:, None]).sum(0) - 0.5, 0.01).astype(np.float32) * 2

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the nearest codeword, its share among all (0 to 1), and its lead over the second."""
        margin = x @ self.w + self.bias
        loss = np.stack([(np.logaddexp(0, -c * margin) * self.weight).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ordered = np.sort(p, 1)
        return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()).astype(np.float16).tobytes() for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])


def learn(docs: DataFrame, per_language: int = 300) -> Decoder:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Decoder(np.zeros((0, 1 << BITS), np.float32), [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text")
    got = sorted((r.lang, bytes(r.x)) for r in chosen.mapInArrow(_sampled, "lang string, x binary").collect())  # sorted: reruns agree
    if not got:
        return Decoder(np.zeros((0, 1 << BITS), np.float32), [])
    return Decoder(np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32), [k for k, _ in got])


def identify(docs: DataFrame, decoder: Decoder, margin: float = 0.05) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: a row for each row of docs."""
    langs = decoder.langs

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            lang, score, doubt = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            known = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
            for k in range(0, len(known), 256):
                part = known[k : k + 256]
                best, p, lead = decoder.decode(np.stack([features(texts[i]) for i in part]))
                for i, j, s, d in zip(part, best, p, lead, strict=True):
                    lang[i], score[i], doubt[i] = langs[j], min(1.0, float(s)), bool(d < margin)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang), pa.array(score, pa.float64()), pa.array(doubt)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, decoder: Decoder, margin: float = 0.05) -> DataFrame:
    """docs less those that are `und` or ambiguous; the columns stay."""
    langs = decoder.langs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [t.as_py() for t in b.column(at)]
            known = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
            kept = []
            for k in range(0, len(known), 256):
                part = known[k : k + 256]
                lead = decoder.decode(np.stack([features(texts[i]) for i in part]))[2]
                kept += [i for i, d in zip(part, lead, strict=True) if d >= margin]
            yield b.take(pa.array(kept, pa.int64()))

    return docs.mapInArrow(keep, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
