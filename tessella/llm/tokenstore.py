"""Token-ID output as a content-addressed store.

Each document's ids (with an end id) are cut where a rolling hash of the last ids says so, so equal passages give
equal chunks wherever they stand. Three tables make a file set in the shared folder:

- chunks: chunk (128-bit BLAKE2b of the payload), payload (one byte: width of an id; then the ids, little-endian). Each once.
- recipes: part, doc_id, start (ids of all documents before it), n_tokens, root (Merkle root of its chunks), chunks; in ascending doc_id order.
- manifest: for each part (PART ids) of the recipes its first start, its end, number of documents and ids, and the Merkle root of their roots.

Writing: documents are encoded once, into a table that is bucketed by the task that wrote it. Names alone go out to find the first place of each
chunk; that place is told to the task's bucket, so payloads are written from where they lie and never shuffled.

Reading checks every part of the recipes against the manifest (a lost or changed recipe, file or part is an error), each document
against its root, and each payload against its name. read_back() takes a checksum of each chunk where it lies and joins the
checksums by the recipes; read_ids() brings the ids themselves to the documents.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows of equal doc_id are documents of
their own, ordered by root; an empty table gives empty tables; other columns are not read. The cut has a least and a greatest length; the
greatest cuts on, it drops nothing.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import marshal
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, beside, complete_groups, dealt, group_starts, read, running_total, shuffles

WINDOW = 16
LEAST, AVERAGE, MOST = 128, 1024, 16384  # ids in a chunk; AVERAGE is a power of two
PART = 1 << 20  # ids of a part of the recipes
ROWS = 1024  # documents encoded at a time
STAGED = 1 << 19  # ids in a row of the table that documents are encoded to
#: Parquet looks at a page's size every 100 rows; rows of 1 MB would all be one page, which snappy holds whole outside the heap, twice, to write it and to read it.
PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": False}
UNICODE_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ODD = re.compile(rf"\A\n?\Z|\A\n?[\t\r]|[\t\r]\Z|[\x0b\x0c\x1c-\x1f{UNICODE_SPACE}]|<\|")  # units where white space meets white space, or may


SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = re.compile(r"[^\W\d_]+|[0-9]+|[!-&(-/:-@\[-`{-~]+")  # letters, digits, ASCII signs but the apostrophe: the pre-tokenizer parts a word so


class Encoder:
    """A byte-level BPE of the tokenizers library, with a bounded memory of what stands between single spaces and newlines.

    Its pre-tokenizer always parts at a space or newline that stands alone, so what it makes of the units between them is what it makes
    of the whole; a unit of letters, digits and signs goes to the library's model piece by piece. Texts where white space
    meets white space, or with `<|`, are encoded whole; a unit tells when it is first met, and then has no ids. The memory has two
    generations of `remember` units: what is asked for again outlives the older one.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.tokenize = self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.encode_all = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]  # byte-level alphabet: these stand for themselves
        hidden = iter(range(256, 512))
        self.letters = {c: chr(c) if c in shown else chr(next(hidden)) for c in range(256)}
        self.space = self.letters[32]
        self.newline, self.lone_space = self._ids(["\n", " "])
        self.known, self.bare = _Known(self._unit), _Known(self._bare)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.encode_all(texts, add_special_tokens=False)]

    def _piece(self, piece: str, lead: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(lead + shown)])

    def _bare(self, piece: str) -> bytes:
        self.bare[piece] = out = self._piece(piece, "")
        return out

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit: one that begins with a newline has no space before it, any other has one."""
        known = self.known
        if unit.isalpha():
            known[unit] = out = self._piece(unit, self.space)
            return out
        word = unit.rstrip(SIGNS)
        if word.isalpha() and "<|" not in unit:
            ids, signs = known.get(word) or known.older.get(word), self.bare[unit[len(word) :]]
            if ids:
                known[unit] = out = ids + signs
                return out
            known[word] = out = self._piece(word, self.space)  # in the unit's place: a rare word is met once, and if not, then often with other signs
            return out + signs
        known[unit] = out = self._mixed(unit)
        return out

    def _mixed(self, unit: str) -> bytes:
        """Nothing if they depend on what stands beside the unit."""
        if ODD.search(unit):
            return b""
        lone = unit[:1] == "\n"
        pieces = PIECES.findall(unit)
        if not pieces or len(unit) - lone != sum(map(len, pieces)) or not all(p.isascii() or p.isalpha() for p in pieces):
            return self._ids([unit if lone else " " + unit])[0]
        if lone:
            return self.newline + b"".join(map(self.bare.__getitem__, pieces))
        return self._piece(pieces[0], self.space) + b"".join(map(self.bare.__getitem__, pieces[1:]))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.width.

        Arrow cuts texts to units and tells different ones apart, and lays their ids end to end; what stands once in the texts is looked up once.
        """
        for known in (self.known, self.bare):
            if len(known) > self.remember:
                known.age()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        spaced = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "\n\n"))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(spaced, pa.scalar("", texts.type), texts), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        units = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        ids = list(map(self.known.__getitem__, pc.binary_join(units, " ")[0].as_py().split(" ")))  # no unit has a space in it
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        first, last = bounds[:-1], bounds[1:] - 1
        at = np.array(coded.indices, np.int64)
        heads, tails = coded.take(first).to_pylist(), coded.take(last).to_pylist()
        end = np.array([x in ("", "\n") for x in tails]) & (last > first)  # alone at the end, no white space follows
        at[last[end]] = [len(ids) + (x == "\n") for x, e in zip(tails, end.tolist(), strict=True) if e]
        ids += [self.lone_space, self.newline, b""]
        at[first] = len(ids) + np.arange(len(first))  # first units have no space before them
        mixed = np.array([not x for x in ids[:-3]] + [False] * (3 + len(first)))  # units that need what stands beside them
        odd = np.logical_or.reduceat(mixed[at], first) | spaced.to_numpy(zero_copy_only=False)
        odd |= [bool(x and ODD.search(x)) for x in heads]
        at[np.repeat(odd, last - first + 1)] = len(ids) - 1
        at[first] = len(ids) + np.arange(len(first))
        plain = [not o and x.isalpha() for x, o in zip(heads, odd.tolist(), strict=True)]
        whole = iter(self._ids([texts[i].as_py() if o else x for i, (x, o, p) in enumerate(zip(heads, odd.tolist(), plain, strict=True)) if not p]))
        ids += [self.bare[x] if p else next(whole) for x, p in zip(heads, plain, strict=True)]
        joined = pa.array(ids, pa.binary()).take(pa.array(at))
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[bounds].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(ends, ends[1:], strict=False)]

    def rest(self) -> None:
        """Between tasks a worker keeps what was asked for in two generations, as copies that lie together: so idle workers give memory back.

        All else goes before the copies are made, and they are made without a memo, so resting takes little more than the memory has.
        """
        for k in (self.known, self.bare):
            kept = {u: x for u, x in k.items() if u in k.older} if k.older else dict(k)
            k.clear()
            k.older = {}
            data = marshal.dumps(kept, 2)
            del kept
            k.older = marshal.loads(data)
        trim()


def trim() -> None:
    """Gives back what the allocators hold free."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's
        libc.malloc_trim(0)


class _Known(dict):
    """What has been asked for before, and else what `make` makes of it and notes down."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.older.get(unit)
        if out is None:
            return self.make(unit)
        self[unit] = out
        return out

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker, which outlives tasks. It is tasks that run side by side: threads of the library's own would take memory each."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    out = Encoder(path)
    trim()  # what reading the file took
    return out


def forget() -> None:
    """Reading needs no encoder: a worker that has one gives its memory back before it reads."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its memories refer to each other
        trim()


def marks(ids: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Places whose last WINDOW ids have a hash in one of `average` cells."""
    h, p, n = ids.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < WINDOW:
            h = h[:-n] * p + h[n:]
            p, n = p * p, 2 * n
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(65 - average.bit_length())) == 0) + WINDOW


def cuts(n: int, marked: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of n ids: the marks, at least `least` and at most `most` apart."""
    out, last = [], 0
    for m in [*marked, n]:
        while m - last > most:
            last += most
            out.append(last)
        if m - last >= least and m < n:
            out.append(m)
            last = m
    return out if out and out[-1] == n else [*out, n]


def all_cuts(sizes: list[int], ids: np.ndarray) -> list[list[int]]:
    """cuts() of each of several streams that are laid end to end."""
    at, end = marks(ids), np.cumsum(sizes)
    lo, hi = np.searchsorted(at, end - sizes + WINDOW), np.searchsorted(at, end, "right")
    return [cuts(n, (at[a:b] - (e - n)).tolist()) for n, a, b, e in zip(sizes, lo.tolist(), hi.tolist(), end.tolist(), strict=True)]


def name(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in level]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


STAGE = "b int, seq int, doc_ids array<long>, n_tokens array<long>, roots array<binary>, names array<array<binary>>, payloads array<binary>"
STAGE_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.binary())), pa.list_(pa.binary())]


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        w, task, seq, size = bpe.width, TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], f"<u{w}").tobytes()
        held: tuple = ([], [], [], [], [])

        def out() -> pa.RecordBatch:
            nonlocal seq, size
            row = pa.record_batch([pa.array([x], t) for x, t in zip((task, seq, *held), STAGE_TYPES, strict=True)], names=["b", "seq", "doc_ids", "n_tokens", "roots", "names", "payloads"])
            seq, size = seq + 1, 0
            for x in held:
                x.clear()
            return row

        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                raws = [x + end for x in bpe.encode(part.column(1).fill_null(""))]
                for i, raw, ends in zip(part.column(0).to_pylist(), raws, all_cuts([len(x) // w for x in raws], np.frombuffer(b"".join(raws), f"<u{w}")), strict=True):
                    chunks = [bytes([w]) + raw[i * w : j * w] for i, j in zip([0, *ends], ends, strict=False)]
                    named = [name(c) for c in chunks]
                    for x, v in zip(held, (i, len(raw) // w, merkle(named), named), strict=False):
                        x.append(v)
                    held[4].extend(chunks)
                    size += len(raw) // w
                    if size >= STAGED:
                        yield out()
        if held[0]:
            yield out()
        b = part = raws = raw = chunks = v = None  # what the last documents took
        bpe.rest()

    return run


class Part:
    """What the manifest says of a part, from its recipes in order."""

    def __init__(self, start: int):
        self.first = self.end = start
        self.roots: list[bytes] = []

    def add(self, start: int, n: int, root: bytes) -> None:
        if start != self.end:
            raise ValueError(f"recipes are lost before id {start}")
        self.end += n
        self.roots.append(root)

    def row(self) -> tuple:
        return self.first, self.end, len(self.roots), merkle(self.roots)


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and start."""
    part, x = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v]) for v in (part, *x.row())], names=["part", "first_start", "end", "n_docs", "root"])

    for b in batches:
        for p, start, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "start", "n_tokens", "root")), strict=True):
            if p != part:
                if x is not None:
                    yield row()
                part, x = p, Part(start)
            x.add(start, n, root)
    if x is not None:
        yield row()


def write(docs: DataFrame, ws: Workspace, tokenizer: str, end_id: int = 2) -> dict[str, str]:
    """Writes chunks, recipes and manifest; their paths by name."""
    spark = docs.sparkSession
    staged = ws.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded(tokenizer, end_id), STAGE), "staged", "b", "snappy", PAGES)
    at = {k: ws.path(k) for k in ("chunks", "recipes", "manifest")}
    named = staged.select("b", "seq", F.posexplode(F.flatten("names")).alias("place", "name"))
    first = named.groupBy("name").agg(F.min(F.struct("b", "seq", "place")).alias("at")).select("at.*")
    own = beside(staged.select("b", "seq", F.flatten("names").alias("names"), "payloads"), first, "own", "place")
    pick = F.transform("own", lambda x: F.struct(F.get("names", x["place"]).alias("chunk"), F.get("payloads", x["place"]).alias("payload")))
    own.select(F.explode(pick).alias("c")).select("c.*").write.option("compression", "snappy").parquet(at["chunks"])
    each = staged.select(F.explode(F.arrays_zip("doc_ids", "n_tokens", "roots", "names")).alias("d"))
    recipes = ws.save(each.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.roots").alias("root"), F.col("d.names").alias("names")), "unplaced")
    ws.drop(staged)
    placed = running_total(recipes, "n_tokens", [F.col("doc_id").asc_nulls_first(), F.col("root")], None, [], "start", ws)
    start = F.col("start").cast("long")
    ordered = placed.select(F.floor(start / PART).alias("part"), "doc_id", start.alias("start"), "n_tokens", "root", F.col("names").alias("chunks")).repartitionByRange(shuffles(spark), "start").sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(at["recipes"])
    ws.drop(recipes)
    parts = spark.read.parquet(at["recipes"]).select("part", "start", "n_tokens", "root").repartition(shuffles(spark), "part").sortWithinPartitions("part", "start")
    parts.mapInArrow(_manifest, "part long, first_start long, end long, n_docs long, root binary").write.parquet(at["manifest"])
    return at


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, the manifest's first: a row for each chunk of each recipe, once a document agrees with its root."""
    forget()
    said, x = None, None

    def close() -> None:
        if said is not None and x.row() != said[1:]:
            raise ValueError(f"part {said[0]} of the recipes isn't what the manifest says")

    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for part, doc_id, start, n, root, chunks, *told in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "root", "chunks", "first_start", "end", "n_docs")), strict=True):
            if chunks is None:
                close()
                said, x = (part, *told, root), Part(told[0])
                continue
            if said is None or said[0] != part:
                raise ValueError(f"the manifest has no part {part}")
            if merkle(chunks) != root:
                raise ValueError(f"document {doc_id} doesn't match its root")
            x.add(start, n, root)
            for c, v in zip(out, ([doc_id] * len(chunks), [start] * len(chunks), [n] * len(chunks), [len(chunks)] * len(chunks), range(len(chunks)), chunks), strict=True):
                c.extend(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "n_chunks", "place", "chunk"])
    close()


def verified(spark: SparkSession, at: dict[str, str]) -> DataFrame:
    """doc_id, start, n_tokens, n_chunks, place, chunk: the recipes, as the manifest says they must be."""
    manifest = spark.read.parquet(at["manifest"])
    whole = manifest.agg(F.sum(F.col("end") - F.col("first_start")), F.max("end")).first()
    if (whole[0] or 0) != (whole[1] or 0):
        raise ValueError("the manifest lacks parts")
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    said = manifest.select("part", *null("long", "doc_id", "start", "n_tokens"), "root", *null("array<binary>", "chunks"), "first_start", "end", "n_docs")
    recipes = spark.read.parquet(at["recipes"]).select("part", "doc_id", "start", "n_tokens", "root", "chunks", *null("long", "first_start", "end", "n_docs"))
    rows = said.union(recipes).repartition(shuffles(spark), "part").sortWithinPartitions("part", F.col("chunks").isNotNull(), "start")
    return rows.mapInArrow(_verified, "doc_id long, start long, n_tokens long, n_chunks int, place int, chunk binary")


def _ids(chunk: bytes, payload: bytes) -> np.ndarray:
    if name(payload) != chunk:
        raise ValueError(f"chunk {chunk.hex()} is changed")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        sums: list[tuple[int, int]] = []
        for k in range(0, b.num_rows, 256):
            for c, p in zip(*(x.to_pylist() for x in b.slice(k, 256).columns), strict=True):
                ids = _ids(c, p)
                sums.append((len(ids), zlib.crc32(ids)))
        yield pa.record_batch([b.column(0), *(pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1))], names=["chunk", "n", "crc"])


@functools.cache
def _zeros() -> np.ndarray:
    """What 2**k bytes of zeros behind a text do to its crc32, which is linear: for each k and byte of the crc, a table of 256."""
    step = np.concatenate(([0xEDB88320], 1 << np.arange(31))).astype(np.uint32)  # one bit
    out = np.zeros((44, 4, 256), np.uint32)

    def apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce(np.where(x[None] >> np.arange(32, dtype=np.uint32)[:, None] & 1 == 1, m[:, None], np.uint32(0)), 0)

    for k in range(-3, 44):
        if k >= 0:
            for j in range(4):
                out[k, j] = apply(step, np.arange(256, dtype=np.uint32) << np.uint32(8 * j))
        step = apply(step, step)
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part in a longer text's crc32 of a text that n bytes follow."""
    crc, tables = crc.astype(np.uint32), _zeros()
    for k in range(int(n.max(initial=0)).bit_length()):
        on = np.flatnonzero(n >> k & 1)
        x = crc[on]
        crc[on] = tables[k, 0][x & 255] ^ tables[k, 1][x >> 8 & 255] ^ tables[k, 2][x >> 16 & 255] ^ tables[k, 3][x >> 24]
    return crc


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document and place: each document's checksum is that of its chunks, one after another."""
    for t in complete_groups(batches, ["start"]):
        starts = group_starts(t, ["start"])
        first = starts[:-1]
        if t.column("crc").null_count:
            raise ValueError(f"a chunk of document {t.column('doc_id')[t.column('crc').to_pylist().index(None)]} is lost")
        n, crc, total, doc = (t.column(c).to_numpy() for c in ("n", "crc", "n_tokens", "start"))
        end = np.cumsum(n)
        size = np.diff(starts)
        last = np.repeat(end[starts[1:] - 1], size)
        got = end[starts[1:] - 1] - end[first] + n[first]
        if (got != total[first]).any() or (size != t.column("n_chunks").to_numpy()[first]).any():
            raise ValueError(f"document at id {doc[first][np.flatnonzero(got != total[first])]} hasn't its length")
        whole = np.bitwise_xor.reduceat(shifted(crc, 4 * (last - end)), first).astype(np.int64)
        yield pa.record_batch([t.column("doc_id").combine_chunks().take(pa.array(first)), pa.array(doc[first]), pa.array(total[first]), pa.array(whole)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, at: dict[str, str]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    sums = spark.read.parquet(at["chunks"]).select("chunk", "payload").mapInArrow(_checksums, "chunk binary, n long, crc long")
    both = verified(spark, at).join(sums, "chunk", "left")
    return dealt(both, ["start"], _joined, "doc_id long, start long, n_tokens long, ids_crc32 long", "place")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in complete_groups(batches, ["start"], 1024):
        starts = group_starts(t, ["start"])
        chunks, payloads = t.column("chunk").to_pylist(), t.column("payload").to_pylist()
        if None in payloads:
            raise ValueError(f"a chunk of document {t.column('doc_id')[payloads.index(None)]} is lost")
        ids = [np.concatenate([_ids(chunks[i], payloads[i]) for i in range(a, b)]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        first = pa.array(starts[:-1])
        yield pa.record_batch([t.column("doc_id").combine_chunks().take(first), t.column("start").combine_chunks().take(first), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, at: dict[str, str]) -> DataFrame:
    """doc_id, start, ids of each document, from the files."""
    both = verified(spark, at).join(spark.read.parquet(at["chunks"]), "chunk", "left")
    return dealt(both, ["start"], _gathered, "doc_id long, start long, ids array<int>", "place")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return read_back(spark, write(docs, Workspace(spark, "op5"), public_tokenizers.path("byte_bpe_50k.json")))
