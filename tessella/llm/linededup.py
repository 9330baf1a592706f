"""Line dedup by site-relative frequency.

Pages are grouped by host; a line that is on more than `ratio` of a host's pages is boilerplate there and goes. Pages of one
host with equal text count as one, else the lines of a page that is copied often would all go. On a host of a few pages one or
two are over any ratio, so a line must be on `least_on` pages besides, 3 by default: one or two pages aren't a pattern.

Defined results: a null text gives null; a null host is a host of its own; empty lines are never dropped; lines compare by
their text without white space around it; a line that repeats on a page counts once for it; an empty table gives an empty
table; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free, read

EDGE = " \t\n\x0b\x0c\r"
SALTS = 16  # tasks that a host's lines or a line's pages are dealt to, at most


def html_lines(html: Column) -> Column:
    """The text of a page with a line for each block: scripts, styles, comments and tags go."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|pre|blockquote)|br)([\x20/][^>]*)?>", "\n")
    return F.regexp_replace(x, r"<[^>]*>", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def salted(few: DataFrame) -> DataFrame:
    """few, once for each salt."""
    return few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(c: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), c), F.lit(SALTS)).cast("int")


def boilerplate(pages: DataFrame, ratio: float, least_on: int) -> DataFrame:
    """(_host, _h): hashes of the lines that are boilerplate on a host. pages: _host, _lines (hashes).

    Counts combine before they are shuffled, and the lines of a host meet its total in several tasks, so neither a large
    host nor a common line is a hot key.
    """
    totals = salted(pages.groupBy("_host").agg(F.count("*").alias("_pages"))).select(F.col("_host").alias("_t"), "_pages", F.col("_salt").alias("_ts"))
    on = pages.select("_host", F.explode(F.array_distinct("_lines")).alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_on")).where(F.col("_on") >= least_on)
    both = on.withColumn("_salt", salt("_h")).join(totals, F.col("_host").eqNullSafe(F.col("_t")) & (F.col("_salt") == F.col("_ts")))
    return both.where(F.col("_on") > ratio * F.col("_pages")).select("_host", "_h")


def drop_lines(pages: DataFrame, ws: Workspace, text: str = "text", site: str = "host", ratio: float = 0.1, least_on: int = 3, counts: bool = True) -> DataFrame:
    """pages with `text` less its host's boilerplate lines and, if `counts`, with n_lines and n_dropped (long), which take the place of columns of these names."""
    hashed = F.transform(F.split(F.col(text), "\n"), lambda x: F.xxhash64(F.btrim(x, F.lit(EDGE))))
    empty = F.xxhash64(F.lit(""))
    key = F.struct(F.xxhash64(F.col(site), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text), F.col(site)).alias("b"))  # 128 bits
    rows = pages.select(key.alias("_key"), F.col(site).alias("_host"), F.filter(F.coalesce(hashed, F.array()), lambda h: h != empty).alias("_lines"))
    lines = ws.save(rows.dropDuplicates(["_key"]), "lines")
    bad = ws.save(boilerplate(lines, ratio, least_on), "boilerplate")
    found = lines.select("_key", "_host", salt("_key").alias("_salt"), F.explode(F.array_distinct("_lines")).alias("_h"))
    bad = salted(bad).select(F.col("_host").alias("_b"), F.col("_h").alias("_bh"), F.col("_salt").alias("_bs"))
    hit = found.join(bad, F.col("_host").eqNullSafe(F.col("_b")) & (F.col("_h") == F.col("_bh")) & (F.col("_salt") == F.col("_bs"))).select("_key", "_h")
    k, bad_lines, kept = free(pages, "_key", "_drop", "_keep")
    per = hit.groupBy(F.col("_key").alias(k)).agg(F.collect_set("_h").alias(bad_lines))  # a page's own lines at most
    out = pages.withColumn(k, key).join(per, k, "left").withColumn(bad_lines, F.coalesce(bad_lines, F.array().cast("array<bigint>")))
    split = F.split(F.col(text), "\n")
    keep = F.filter(split, lambda x: ~F.array_contains(F.col(bad_lines), F.xxhash64(F.btrim(x, F.lit(EDGE)))))
    out = out.withColumn(kept, F.when(F.size(bad_lines) == 0, split).otherwise(keep))
    n = F.coalesce(F.size(split), F.lit(0)).cast("long")
    cols = [F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in pages.columns if not (counts and c.lower() in ("n_lines", "n_dropped"))]
    if counts:
        cols += [F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped")]
    return out.select(*cols)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_lines(pages, Workspace(spark, "op4")).select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
    '(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|pre|blockquote)|br)([\x20/][^>]*)?>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS text FROM pages),
k AS (SELECT row_number() OVER () AS row, page_id, host, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM p),
u AS (SELECT host, text, any_value(lines) AS lines FROM k GROUP BY host, text),
e AS (SELECT row, host, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM k, unnest(range(1, len(lines) + 1)) AS r(i)),
v AS (SELECT host, text, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM (SELECT host, text, unnest(lines) AS line FROM u)),
t AS (SELECT host, count(*) AS pages FROM u GROUP BY host),
b AS (SELECT v.host, bare FROM v JOIN t ON v.host IS NOT DISTINCT FROM t.host WHERE bare <> '' GROUP BY v.host, bare, pages
  HAVING count(DISTINCT text) >= 3 AND count(DISTINCT text) > 0.1 * pages),
m AS (SELECT row, count(*) AS n_lines, count(b.bare) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.bare IS NULL), '') AS kept
  FROM e LEFT JOIN b ON e.host IS NOT DISTINCT FROM b.host AND e.bare = b.bare GROUP BY row)
SELECT page_id, k.host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM k LEFT JOIN m ON k.row = m.row
"""
