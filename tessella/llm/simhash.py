"""SimHash near-dedup by a binary trie that joins itself.

Equal fingerprints are one leaf. If a fingerprint's 64 bits are cut into blocks, two fingerprints that differ in at most four
bits agree in all but four of these. So each choice of so many blocks in turn is put first, and splits the trie into subtries that
tasks hold: below common first blocks, pairs of nodes are traversed together, a pair's differing bits are summed, and the pair is
left when they exceed the budget. How many blocks there are goes by the number of fingerprints, so that a subtrie has
LIMIT of them or fewer on average: 5 layouts of 12 bits or more, then 15 of 21, then 70 of 32. A pair whose leaves are all linked already is left too, as only the
components are asked for; that keeps a large group of near copies from costing its square. Each task returns a spanning forest.

Defined results: a null or empty text has no words and the fingerprint zero, which links like any other; rows of equal
doc_id are one node; a row with a null doc_id gets its fingerprint and no component, and links with nothing; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, among, blocked, complete_groups, connected_components, dealt, find, free, group_starts, numbered, read, unite
from .jaccard import similar

BUDGET = 4  # bits that may differ
LIMIT = 8192  # fingerprints of a subtrie in one task; more are dealt in pairs of chunks


def layouts(n: int, limit: int = LIMIT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """For n fingerprints: orders of the blocks (first bit and length of each), with the bits of those that come first."""
    for blocks in (5, 6, 8):
        cut = [64 * i // blocks for i in range(blocks + 1)]
        if blocks == 8 or n < limit << min(sum(sorted(b - a for a, b in zip(cut, cut[1:], strict=False))[: blocks - BUDGET]), 62):
            break
    parts = [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]
    lead = [c for c in itertools.combinations(range(blocks), blocks - BUDGET)]
    return [((*(parts[i] for i in c), *(x for i, x in enumerate(parts) if i not in c)), sum(parts[i][1] for i in c)) for c in lead]


def turned(fp: np.ndarray, order: tuple[tuple[int, int], ...]) -> np.ndarray:
    """fp with its blocks in that order."""
    out = np.zeros_like(fp)
    for at, n in order:
        out = (out << np.uint64(n)) | ((fp >> np.uint64(64 - at - n)) & np.uint64((1 << n) - 1))
    return out


def fingerprint(text: bytes, words: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    w = text.lower().split()  # of bytes: only A-Z change, and only the six ASCII white spaces part words
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, stops = np.concatenate(([0], ends))[:n].tolist(), (ends[min(words, len(w)) - 1 :] - 1).tolist()
    joined, hashed = b" ".join(w), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, step):
        h = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[i : i + step], stops[i : i + step], strict=True)), np.uint64, min(step, n - i))
        ones += np.unpackbits(h.byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.array([fingerprint(x.as_py() or b"") for x in b.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(got)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def trie_join(fp: np.ndarray, roots: list[tuple[int, int, int, int]], first: int, budget: int, most: int = 1 << 18) -> np.ndarray:
    """For the leaves fp (uint64, sorted within each root's range), the parent of each in a forest of the links.

    roots: pairs of ranges (a, b, c, d) that join, the same range twice for a join with itself; all fingerprints of
    a pair agree in the `first` bits. A node is a range of leaves with a common prefix.
    """
    parent = np.arange(len(fp), dtype=np.int64)
    label, rises = parent.copy(), parent.copy()
    rank: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in rank:
            rank[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        return rank[bit]

    stack = [(first, np.array(roots, np.int64).reshape(-1, 4), np.zeros(len(roots), np.int64))]
    while stack:
        bit, r, err = stack.pop()
        if len(r) > most:
            half = len(r) // 2
            stack += [(bit, r[half:], err[half:]), (bit, r[:half], err[:half])]
            continue
        one = (rises[r[:, 1] - 1] == rises[r[:, 0]]) & (rises[r[:, 3] - 1] == rises[r[:, 2]]) & (label[r[:, 0]] == label[r[:, 2]])
        r, err = r[~one], err[~one]
        if not len(r):
            continue
        na, nb = r[:, 1] - r[:, 0], r[:, 3] - r[:, 2]
        small = (na * nb <= 16) | (bit == 64)
        if small.any():
            _leaves(fp, parent, r[small], na[small], nb[small], budget, most)
            label = find(parent, np.arange(len(fp)))
            rises = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            r, err = r[~small], err[~small]
        if not len(r):
            continue
        o = ones(bit)
        a, b, c, d = r.T
        p, q = b - (o[b] - o[a]), d - (o[d] - o[c])
        same = a == c
        kids = [(np.stack((a, p, c, q), 1), err, same), (np.stack((p, b, q, d), 1), err, same), (np.stack((a, p, q, d), 1), err + 1, same), (np.stack((p, b, c, q), 1)[~same], err[~same] + 1, same[~same])]
        for kid, e, _ in kids:
            keep = (kid[:, 1] > kid[:, 0]) & (kid[:, 3] > kid[:, 2]) & (e <= budget)
            if keep.any():
                stack.append((bit + 1, kid[keep], e[keep]))
        # pairs that agree in this bit come last on the stack's top: near leaves unite first
        stack[-4:] = sorted(stack[-4:], key=lambda s: -int(s[2].min()) if len(s[2]) else 0)
    return find(parent, np.arange(len(fp)))


def _leaves(fp: np.ndarray, parent: np.ndarray, r: np.ndarray, na: np.ndarray, nb: np.ndarray, budget: int, most: int) -> None:
    """Compares the leaves of small node pairs, a slice at a time."""
    n = na * nb
    i = 0
    while i < len(r):
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), 4 * most)) + i)
        k = n[i:j]
        at = np.repeat(np.arange(i, j), k)
        off = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        x, y = r[at, 0] + off // nb[at], r[at, 2] + off % nb[at]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
        near &= x != y
        unite(parent, x[near], y[near])
        i = j


def _join(made: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["layout", "head", "lo", "hi"]
        for t in complete_groups(batches, keys):
            starts = group_starts(t, keys)
            layout, lo, hi, chunk = (t.column(c).to_numpy() for c in ("layout", "lo", "hi", "chunk"))
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            for k in np.unique(layout).tolist():
                rows = np.flatnonzero(layout == k)
                other = turned(fp[rows], made[k][0])
                order = np.lexsort((other, chunk[rows], group[rows]))
                rows, other = rows[order], other[order]
                g, c = group[rows], chunk[rows]
                cut = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1])) + 1, [len(rows)]))
                roots, i = [], 0
                while i < len(cut) - 1:
                    first = rows[cut[i]]
                    if lo[first] == hi[first]:
                        roots.append((cut[i], cut[i + 1], cut[i], cut[i + 1]))
                    elif i + 2 < len(cut) and g[cut[i + 1]] == g[cut[i]]:
                        roots.append((cut[i], cut[i + 1], cut[i + 1], cut[i + 2]))
                        i += 1
                    i += 1
                roots = [x for x in roots if x[1] - x[0] > 1 or x[0] != x[2]]
                if not roots:
                    continue
                top = trie_join(other, roots, made[k][1], BUDGET)
                linked = np.flatnonzero(top != np.arange(len(top)))
                if len(linked):
                    yield pa.record_batch([pa.array(rep[rows[linked]]), pa.array(rep[rows[top[linked]]])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for each row of docs.

    Fingerprints are the nodes of the component search, each under its smallest doc_id; documents join their fingerprint's component after it.
    """
    fps = ws.save(fingerprints(docs), "fingerprints")
    reps = ws.save(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "leaves")
    made = layouts(reps.count(), LIMIT)
    head = lambda order, first: reduce(lambda x, y: x.bitwiseOR(y), [F.expr(f"shiftleft(shiftrightunsigned(fp, {64 - at - n}) & {(1 << n) - 1}L, {first - sum(m for _, m in order[: i + 1])})") for i, (at, n) in enumerate(order) if sum(m for _, m in order[:i]) < first])
    heads = [F.struct(F.lit(i).alias("layout"), head(order, first).alias("head")) for i, (order, first) in enumerate(made)]
    rows = reps.withColumn("h", F.explode(F.array(*heads))).select("h.layout", "h.head", "fp", "rep")
    links = ws.save(dealt(blocked(rows, ["layout", "head"], "fp", LIMIT), ["layout", "head", "lo", "hi"], _join(made), "a long, b long"), "links")
    parts = connected_components(links, ws)
    known = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component"))
    both = fps.join(known, F.col("fp") == F.col("_fp"), "left")
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, ws: Workspace, similarity: float | None = None) -> DataFrame:
    """One row of docs of each component of near copies, linked too by the Jaccard similarity of five-word shingles if given: that of the smallest doc_id, one with a null doc_id only where all are null."""
    row, was, bucket = free(docs, "_row", "_was", "_bucket")
    rows = numbered(docs, ws, row, bucket)
    near = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), ws)
    near = ws.save(near.select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")), "near")
    if similarity is not None:
        links = similar(rows.select(F.col(row).alias("node"), F.col(bucket).alias("b"), "text"), near, ws, similarity=similarity)
        parts = ws.save(connected_components(links.union(near.where("node <> group")), ws), "similar").withColumnRenamed("node", "_n")
        near = ws.save(near.join(parts, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("component", "group").alias("group")), "near")
    ids = rows.select(F.col(row).alias(was), F.col("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("node").alias("node")))
    kept = near.join(ids, F.col("node") == F.col(was)).groupBy("group").agg(first.alias("first")).select("first.node")
    gone = near.join(kept, "node", "left_anti").select(F.col("node").alias(was))
    return among(rows, row, bucket, gone, there=False).drop(row, bucket)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), Workspace(spark, "op10"))
