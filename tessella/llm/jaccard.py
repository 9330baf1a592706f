"""Pairs of documents by the Jaccard similarity of their word shingles: MinHash bands, then the exact similarity.

A document is the set of its hashed shingles of `words` words. ROWS minima of permuted sets make a band; documents that agree in one of the BANDS
bands are candidates, so a pair of similarity s is missed with the probability (1 - s**ROWS)**BANDS: 1 in 9,000 at 0.8. The sets of such
documents (32 bits of each hash) go to the bands' buckets and are compared there, whole; a task returns a spanning forest, never pairs. Documents that are linked already (`group`) aren't compared, as only the components are asked for, and
documents of equal sets are one, as are buckets of the same documents. Texts stay in the tasks that they are read in: what is asked about them goes there.

Defined results: a document of fewer words than a shingle has one shingle, its words; a null or empty text has none and links
with nothing; words compare without A-Z's case; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, among, blocked, complete_groups, dealt, group_starts

BANDS, ROWS = 30, 6
LIMIT = 2048  # documents of a band's bucket in one task; more are dealt in pairs of chunks
_rng = np.random.default_rng(42)
ODD, ADD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(x, seed) for x in w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    out = np.full(n, min(words, len(w)), np.uint64)
    for i in range(min(words, len(w))):
        out = mixed(out + h[i : i + n])
    return np.unique(out)


def bands(s: np.ndarray, step: int = 512) -> np.ndarray:
    """The hash of each band of a set that isn't empty."""
    low = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), step):
        x = s[None, i : i + step] * ODD + ADD
        x ^= x >> np.uint64(32)
        np.minimum(low, (x * ODD).min(1, keepdims=True), out=low)
    low = low.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out + low[:, i])
    return out.view(np.int64)


def _banded(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py() or b"", words) for x in b.column(1)]
            kept = [i for i, s in enumerate(sets) if len(s)]
            keys = [xxhash.xxh128_digest(sets[i].tobytes()) for i in kept]
            heads = np.concatenate([bands(sets[i]) for i in kept]) if kept else np.zeros(0, np.int64)
            heads = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BANDS), pa.array(heads))
            cols = [b.column(0).take(pa.array(kept, pa.int64())), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array(keys, pa.binary()), heads]
            yield pa.record_batch(cols, names=["node", "size", "key", "heads"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([np.unique(shingles(x.as_py() or b"", words).astype(np.uint32)).tobytes() for x in b.column(1)], pa.binary())], names=["node", "set"])

    return run


def _near(similarity: float):
    """For each bucket, links that join its documents of different groups: once linked, documents are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["head", "lo", "hi"]
        for t in complete_groups(batches, keys, 2048):
            starts = group_starts(t, keys)
            lo, hi, chunk, node, group = (t.column(c).to_numpy() for c in ("lo", "hi", "chunk", "node", "group"))
            sets = [np.frombuffer(x, np.uint32) for x in t.column("set").to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            xs, ys = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                label = group[a:b].copy()
                for i in range(b - a - 1):
                    n, m = size[a + i], size[a + i + 1 : b]
                    ok = (label[i + 1 :] != label[i]) & (np.minimum(n, m) + 1e-9 >= similarity * np.maximum(n, m))
                    if lo[a] != hi[a]:
                        ok &= chunk[a + i + 1 : b] != chunk[a + i]
                    js = np.flatnonzero(ok) + i + 1
                    if not len(js):
                        continue
                    own, others = sets[a + i], np.concatenate([sets[a + j] for j in js])
                    hit = own[np.minimum(np.searchsorted(own, others), n - 1)] == others
                    both = np.add.reduceat(hit, np.cumsum(size[a + js]) - size[a + js], dtype=np.int64)
                    js = js[both + 1e-9 >= similarity * (n + size[a + js] - both)]
                    _, first = np.unique(label[js], return_index=True)
                    for j in js[first].tolist():  # one link for each group
                        xs.append(node[a + i])
                        ys.append(node[a + j])
                        label[label == label[j]] = label[i]
            if xs:
                yield pa.record_batch([pa.array(np.array(xs)), pa.array(np.array(ys))], names=["a", "b"])

    return run


def different(met: DataFrame) -> DataFrame:
    """met (node, head, ..) without the buckets that have the same documents as another: near copies meet in most bands, and comparing them once is enough."""
    of = met.groupBy("head").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)])
    return met.join(of.groupBy("n", "x0", "x1").agg(F.min("head").alias("head")).select("head"), "head", "left_semi")


def similar(docs: DataFrame, groups: DataFrame, ws: Workspace, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): links between docs (node, b, text; numbered() by these names, a row for each node) that are at least that similar. groups: (node, group)."""
    texts = docs.select("node", "b", F.col("text").cast("binary").alias("text"))
    made = ws.save(texts.select("node", "text").mapInArrow(_banded(words), "node long, size long, key binary, heads array<long>"), "bands")
    reps = ws.save(made.groupBy("key").agg(F.min("node").alias("node")), "set-leaves")
    same = made.select("node", "key").join(reps.withColumnRenamed("node", "rep"), "key").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    rows = made.drop("key").join(reps.select("node"), "node", "left_semi").join(groups, "node").select("node", "group", "size", F.explode("heads").alias("head"))
    several = rows.groupBy("head").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("head")
    met = ws.save(rows.join(several, "head", "left_semi"), "buckets")
    met = ws.save(different(met), "different-buckets")
    asked = met.select("node").distinct()
    sets = among(texts, "node", "b", asked).select("node", "text").mapInArrow(_sets(words), "node long, set binary")
    rows = blocked(met.select("node", "group", "head"), ["head"], "node", LIMIT).join(sets, "node")
    return dealt(rows, ["head", "lo", "hi"], _near(similarity), "a long, b long").union(same)
