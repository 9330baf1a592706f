"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Points i * golden ratio (mod 1) fall through the cumulative targets of the sources, which gives each slot of the mix a
source; the k-th slot of a source takes its k-th block of BLOCK words, from that source's documents laid end to
end in a shuffled order, again from the start once all are taken. There are as many slots as blocks in the sum of all targets,
and what the mix takes of a document is what the slots' blocks hold of it: a block that no slot has is not taken. The points serve a
source to within a slot or two of its target.

Defined results: a null text has size 0; a document of size 0 takes nothing; a null source is a source, the last one;
repeated rows and equal ids are taken on their own account; an empty table gives an empty table; other columns are
neither read nor needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, free, read, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4096
BLOCK = 1024


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, idx, source_size, target): `share` of all sizes by weight, none above `most` times its source's size.

    The level up to which weights are filled is the largest of what is left over what weight is left, once the sources
    that fill first are full. One row a source, so the windows over all sources are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    idx = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("idx", F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("idx", idx).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = share * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    per = per.withColumn("at", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    target = F.least("cap", F.col("w") * F.max("at").over(every))
    return per.select("source", "idx", "source_size", target.alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """(slot, idx, k): slot's source and its rank among the slots of that source."""
    order = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("target").over(Window.partitionBy())
    lo = F.coalesce(F.sum("target").over(order), F.lit(0.0)) / total
    parts = sources.where("target > 0").select("idx", lo.alias("lo"), F.lead(lo, 1, 1.0).over(Window.orderBy("idx")).alias("hi"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    cells = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("x"))
    slots = points.withColumn("cell", cell(F.col("x"))).join(cells, "cell").where("x >= lo AND x < hi").select("slot", "idx", F.lit(1).alias("one"))
    return running_total(slots, "one", [F.col("slot")], F.shiftright("slot", 16), ["idx"], "k").select("slot", "idx", "k")


def mix(docs: DataFrame, ws: Workspace, block: int = BLOCK, seed: str = "mix", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each piece of a document in a block of its source, with the block's slot in the mix, null where it has none;
    one row with null words for a document without words: doc_id, size, source, source_size, target, at (its place in its
    source), slot, start (its first word), words.

    docs: doc_id, source, text. A slot's pieces, in order of `at` and `start`, are its words.
    """
    spark = docs.sparkSession
    sized = ws.save(docs.select("doc_id", "source", n_words("text").alias("size")), "sized")
    sources = ws.save(targets(sized, weights, share, most), "sources")
    n_slots = math.floor((sources.agg(F.sum("target")).first()[0] or 0) / block + 0.5)
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"]), "inner").select("doc_id", "size", sized["source"], "idx", "source_size", "target")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    known = known.withColumn("_h", key)
    placed = running_total(known, "size", [F.col("_h"), F.col("doc_id"), F.col("size")], F.substring("_h", 1, 3), ["idx"], "at").drop("_h")
    end = F.floor(F.lit(most) * F.col("source_size")).cast("long")  # no source is taken beyond that
    turn = lambda q: F.struct((F.col("at") + q * F.col("source_size")).alias("lo"), F.least(F.col("at") + q * F.col("source_size") + F.col("size"), end).alias("hi"))
    turns = placed.withColumn("t", F.explode_outer(F.filter(F.array(*[turn(q) for q in range(math.ceil(most))]), lambda t: t.hi > t.lo)))
    ks = F.when(F.col("t").isNotNull(), F.sequence(F.floor(F.col("t.lo") / block), F.floor((F.col("t.hi") - 1) / block)))
    cut = turns.withColumn("k", F.explode_outer(ks))
    lo, hi = F.greatest("t.lo", F.col("k") * block), F.least("t.hi", (F.col("k") + 1) * block)
    pieces = cut.select("doc_id", "size", "source", "idx", "source_size", "target", "at", "k", (lo - F.col("t.lo")).alias("start"), (hi - lo).alias("words"))
    out = pieces.join(schedule(spark, sources, n_slots), ["idx", "k"], "left")
    return out.select("doc_id", "size", "source", "source_size", "target", "at", "slot", "start", "words")


def taken(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot: a row for each document. first_slot: where the mix has it first, if it does."""
    by = ["doc_id", "size", "source", "source_size", "target", "at"]
    pieces = mix(docs, ws, **options)
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    some = pieces.where("size > 0").groupBy(*by).agg(words.alias("taken"), F.min("slot").alias("first_slot"))
    none = pieces.where("size = 0").select(*by, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.union(none).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """The documents as often as the mix takes them, in whole copies: words taken over words there are, rounded.

    A document without words isn't taken. Rows of equal doc_id are taken alike.
    """
    of, n, c = free(docs, "_id", "_copies", "_copy")
    copies = taken(docs, ws, **options).where("size > 0").groupBy(F.col("doc_id").alias(of)).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(n))
    both = docs.join(copies.where(F.col(n) > 0), F.col("doc_id").eqNullSafe(F.col(of)), "inner")
    return both.where(n_words("text") > 0).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"), Workspace(spark, "op9"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx FROM s),
w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM i),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER f, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0.0::DOUBLE)) AS lvl
      FROM w WINDOW f AS (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * max(lvl) OVER ()) AS target FROM l),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx FROM t),
c AS (SELECT idx, target, coalesce(sum(target) OVER o, 0.0::DOUBLE) / sum(target) OVER () AS lo, sum(target) OVER () AS total FROM r WINDOW o AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT idx, lo, lead(lo, 1, 1.0::DOUBLE) OVER (ORDER BY idx) AS hi FROM c WHERE target > 0),
n AS (SELECT CAST(floor(coalesce(max(total), 0) / 1024 + 0.5::DOUBLE) AS BIGINT) AS slots FROM c),
x AS (SELECT i AS slot, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS x FROM n, unnest(range(n.slots)) AS u(i)),
k AS (SELECT slot, idx, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS k FROM x JOIN f ON x >= lo AND x < hi),
w2 AS (SELECT idx, count(*) * 1024 AS words FROM k GROUP BY idx),
p AS (SELECT d.doc_id, d.size, r.idx, r.source_size, r.target, least(coalesce(w2.words, 0), 2 * r.source_size) AS words,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|mix'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN w2 ON w2.idx = r.idx)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(pos + size, words) - pos) + greatest(0, least(pos + source_size + size, words) - pos - source_size) AS BIGINT) AS taken,
  CASE WHEN size > 0 THEN k.slot END AS first_slot
FROM p LEFT JOIN k ON k.idx = p.idx AND k.k = p.pos // 1024
"""
