"""Best-fit packing under conflicts.

Documents are dealt by hash to shards of about `shard` pieces. A shard packs its pieces, the largest first: bins are
kept by residual, each residual with a bitmap of its bins, and each source and each cluster of duplicates has a bitmap of
the bins that it must not enter (a cluster: bins that hold one of it; a source: bins that hold `per_source` of it). The search
goes from the smallest residual that fits to its successors until one has a bin that no bitmap forbids; that is the
tightest compatible bin, or else a new one is opened.

A document longer than a bin is cut into full bins and a rest, none of it is dropped. Sizes are words.

Defined results: a null or empty text has no words and is packed nowhere (bin null, one row); null sources and
clusters conflict with nothing; repeated rows are duplicates of each other; null ids are packed like others; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, complete_groups, dealt, group_starts, read
from .mixing import n_words

CAPACITY, PER_SOURCE, SHARD = 4096, 8, 8192


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """Bin of each piece. Pieces come in the order in which they are packed; None conflicts with nothing."""
    out, residuals, at = [], [], {}  # residuals in order; the bitmap of the bins of each
    holds: dict = {}
    full: dict = {}
    counts: dict = {}
    free: list[int] = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        banned = (holds.get(cluster, 0) if cluster is not None else 0) | (full.get(source, 0) if source is not None else 0)
        bit = 0
        for k in range(bisect_left(residuals, size), len(residuals)):
            open_ = at[residuals[k]] & ~banned
            if open_:
                bit = open_ & -open_  # the oldest
                break
        if bit:
            b, r = bit.bit_length() - 1, residuals[k]
            at[r] ^= bit
            if not at[r]:
                del at[r], residuals[k]
        else:
            b, r = len(free), capacity
            bit = 1 << b
            free.append(capacity)
        r -= size
        free[b] = r
        if r:
            if r not in at:
                insort(residuals, r)
                at[r] = 0
            at[r] |= bit
        if cluster is not None:
            holds[cluster] = holds.get(cluster, 0) | bit
        if source is not None:
            counts[source, b] = n = counts.get((source, b), 0) + 1
            if n >= per_source:
                full[source] = full.get(source, 0) | bit
        out.append(b)
    return out


def _pack(capacity: int, per_source: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["shard"], 1):
            starts = group_starts(t, ["shard"])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = t.slice(a, b - a).sort_by([("size", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("source", "ascending"), ("start", "ascending")])
                bins = best_fit(*(part.column(c).to_pylist() for c in ("size", "source", "cluster")), capacity, per_source)
                size = part.column("size").to_numpy()
                order = np.argsort(bins, kind="stable")
                offsets = np.zeros(len(bins), np.int64)
                sorted_bins, ends = np.array(bins)[order], np.cumsum(size[order])
                first = np.searchsorted(sorted_bins, sorted_bins)
                offsets[order] = ends - size[order] - (ends[first] - size[order][first])
                names = [f"{part.column('shard')[0].as_py()}-{x}" for x in bins]
                cols = [part.column(c).combine_chunks() for c in ("doc_id", "source", "cluster", "start", "size")]
                yield pa.record_batch([*cols, pa.array(names), pa.array(offsets)], names=["doc_id", "source", "cluster", "start", "size", "bin", "at"])

    return run


def same_text(text: str = "text") -> Column:
    """The cluster of exact copies: texts that are equal but for case and white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, cluster: Column, ws: Workspace, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """doc_id, source, cluster, start (first word), size (words), bin, at (place in the bin): a row for each piece."""
    sized = ws.save(docs.select(F.col("doc_id").cast("long"), "source", cluster.cast("long").alias("cluster"), n_words("text").alias("n")), "sized")
    total = sized.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    cut = sized.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))))
    start = F.col("k") * capacity
    pieces = cut.select("doc_id", "source", "cluster", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("size"))
    n_shards = max(1, -(-int(total) // shard))
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.lit(8)), F.lit(n_shards)).cast("int"))
    schema = "doc_id long, source string, cluster long, start long, size long, bin string, at long"
    packed = dealt(rows, ["shard"], _pack(capacity, per_source), schema)
    none = sized.where("n = 0").select("doc_id", "source", "cluster", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(0).cast("long"))
    return packed.union(none)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), same_text(), Workspace(spark, "op8"))
