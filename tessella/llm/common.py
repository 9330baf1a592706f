"""What several operators share: tables in the shared folder, blocked self-joins, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where that is unset: a folder of our own for the application's life if all of it runs in this process, as in tests, else one in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            if app not in _own:
                _own[app] = tempfile.mkdtemp(prefix="tessella-")
                atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            where = _own[app]
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-{app}"
    return where.rstrip("/")


BATCH_BYTES = 8 << 20


class Workspace:
    """Parquet tables in the shared folder, which cut lineage and outlive lost executors.

    Operators keep rows of some MB (shards, packs, payloads). Spark gathers rows for Python outside the heap, in buffers that double, until
    they are 64 MB; so a session's larger limit for a batch is lowered. It changes no result: operators take batches as they come.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        limit = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) <= BATCH_BYTES:
            spark.conf.set(limit, str(BATCH_BYTES))
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, bucket: str | None = None, compression: str = "zstd", options: dict | None = None) -> DataFrame:
        """The table that df is written to, with the writer's `options`. With `bucket`, a column, it is bucketed by that one: joins by it leave it where it is."""
        own = uuid.uuid4().hex[:8]
        path, table = self.path(f"{name}-{own}"), f"tessella_{uuid.uuid4().hex}"
        to = df.write.options(**(options or {})).option("compression", compression)
        if bucket:
            to.bucketBy(shuffles(self.spark), bucket).option("path", path).saveAsTable(table)
            out = self.spark.table(table)
            out._tessella_table = table
        else:
            to.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() made and nothing reads any more."""
        if hasattr(df, "_tessella_table"):
            self.spark.sql(f"DROP TABLE IF EXISTS {df._tessella_table}")
        delete(self.spark, df._tessella_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65536) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by keys. A group is never cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = _last_group(table, keys)
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
        rows = max(rows, 2 * n) if not cut else rows
    if held:
        yield pa.Table.from_batches(held)


def _last_group(table: pa.Table, keys: list[str]) -> int:
    """The row at which the last group begins."""
    n = table.num_rows
    same = np.ones(n, bool)
    for k in keys:
        x = table.column(k).to_numpy()
        same &= x == x[-1]
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups, with the number of rows at the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def blocked(rows: DataFrame, keys: list[str], row_id: str, limit: int) -> DataFrame:
    """Rows dealt for a self-join by keys: a key with over `limit` rows is cut into chunks, and each unordered pair
    of chunks (lo, hi) is a group of its own, so that no task holds more than 2 * limit rows of a key.

    Adds lo, hi, chunk. The rows of a group with lo == hi join among themselves, else chunk lo with chunk hi.
    """
    n = F.ceil(F.col("count") / limit).cast("int")
    hot = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, n.alias("_n"))
    with_n = rows.join(hot, keys, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_n")), F.lit(0)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1), lambda j: F.struct(F.least("chunk", j).alias("lo"), F.greatest("chunk", j).alias("hi")))
    return with_n.withColumn("_p", F.explode(pair)).select(*rows.columns, "chunk", "_p.lo", "_p.hi")


def dealt(rows: DataFrame, keys: list[str], fn: Callable, schema: str, *order: str) -> DataFrame:
    """fn over whole groups: each task sees its groups one after another, sorted by keys and, within a group, by `order`."""
    return rows.repartition(shuffles(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(fn, schema)


def beside(rows: DataFrame, told: DataFrame, column: str, *fields: str) -> DataFrame:
    """rows (b, seq, ..; bucketed by b) with a column of what `told` (b, seq, fields) has of each: an array of structs.

    The rows stay where they are, only `told` is shuffled to their buckets; a row takes its own out of its task's, so rows are large and few.
    """
    one = told.groupBy("b").agg(F.collect_list(F.struct("seq", *fields)).alias(column))
    both = rows.join(one.hint("shuffle_hash"), "b", "left")
    own = F.filter(column, lambda x: x["seq"] == F.col("seq"))
    return both.withColumn(column, F.transform(own, lambda x: F.struct(*[x[f].alias(f) for f in fields])))


def numbered(rows: DataFrame, ws: Workspace, row: str, bucket: str) -> DataFrame:
    """rows as a table with a number for each row, bucketed by the task that wrote it, which the number holds."""
    return ws.save(rows.withColumn(row, F.monotonically_increasing_id()).withColumn(bucket, F.shiftright(F.col(row), 33).cast("int")), "rows", bucket)


def among(rows: DataFrame, row: str, bucket: str, some: DataFrame, there: bool = True) -> DataFrame:
    """The numbered() rows whose number is in `some` (its one column, each once), or isn't.

    The rows stay where they are, only numbers are shuffled to their buckets, there in cells, so that no row is held against all of its bucket's.
    """
    (told,), cell = free(rows, "_told"), lambda c: F.shiftright(c, 10)
    ids = some.toDF("id").select(F.shiftright("id", 33).cast("int").alias(told + "b"), "id", cell("id").alias("cell"))
    cells = ids.groupBy(told + "b", "cell").agg(F.collect_list("id").alias("ids"))
    one = cells.groupBy(told + "b").agg(F.collect_list(F.struct("cell", "ids")).alias(told))
    both = rows.join(one.hint("shuffle_hash"), F.col(bucket) == F.col(told + "b"), "left")
    has = F.coalesce(F.exists(told, lambda x: (x["cell"] == cell(F.col(row))) & F.array_contains(x["ids"], F.col(row))), F.lit(False))
    return both.where(has if there else ~has).select(*rows.columns)


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of all pairs (a, b) in place; a root is the smallest index of its set."""
    while len(a):
        ra, rb = find(parent, a), find(parent, b)
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent[a] = find(parent, a)
        parent[b] = find(parent, b)


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path,
    no node's neighbours are ever gathered in one row, and each round is a table in the shared folder. A node's neighbours are
    dealt over SALTS tasks, and its smallest neighbour goes to each of these, so a star's centre is no hot key.
    """
    e = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _checksum(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_smallest(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = ws.save(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        ws.drop(e)
        e, was, seen = new, seen, _checksum(new)
        if seen == was:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


SALTS = 32


def _with_smallest(e: DataFrame) -> DataFrame:
    """e (u, v) with m, the smallest v of each u. Smallest ones are combined before they are shuffled."""
    salted = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    some = salted.groupBy("u", "s").agg(F.min("v").alias("m"))  # what u's salts have
    least = some.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))  # at most SALTS rows each
    return salted.join(least.select("u", F.explode("s").alias("s"), "m"), ["u", "s"]).select("u", "v", "m")


def _checksum(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def running_total(df: DataFrame, value: str, order: list[Column], bucket: Column | None, group: list[str], out: str, ws: Workspace | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that come before in `order`.

    bucket must not fall as order rises; without one, rows are sorted into ranges of equally many (and written to ws). Only
    the totals of buckets are summed in sequence, so no task sorts a group.
    """
    if bucket is None:
        ranged = df.repartitionByRange(shuffles(df.sparkSession), *[F.col(g) for g in group], *order)
        b = ws.save(ranged.withColumn("_b", F.spark_partition_id()), "ranges")
    else:
        b = df.withColumn("_b", bucket)
    sums = b.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_b").eqNullSafe(F.col("_gb"))]
    inner = Window.partitionBy(*[F.col(g) for g in group], "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = b.join(before, on, "inner").select(*df.columns, "_b", "_before")
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_b", "_before")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
