import random
import tracemalloc
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import tokenstore
from tessella.llm.common import Workspace
from tessella.llm.tokenstore import Encoder, all_cuts, read_back, read_ids, shifted, write

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "two words", " lead and trail ", "x  y", "tab\t here \nline\n next", "can't we'll 12 3.5 --- ...", "é ñ ß 日本 語 x 　y", "<|endoftext|> in text", "a\x0b b \x1c c", "end\n", "\n\n  \n"]


def want(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_library():
    rng = random.Random(2)
    alphabet = ["a", "Bc", "é", "1", "'s", " ", "  ", "\n", "\t", ".", "!?", " ", "_", "日", " x", "...", "ª", "²", "word", "don't", "(a)", "é,", "ß.", "<|", "\x0b", "\r", " \n", "\u3000"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(3000)]
    t, e = Tokenizer.from_file(PATH), Encoder(PATH, remember=50)
    for k in range(0, len(texts), 97):
        part = texts[k : k + 97]
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]
        if k % 5 == 0:
            e.rest()
    assert len(e.known) + len(e.known.older) < len(texts)


def test_resting_takes_little_memory():
    e, n = Encoder(PATH), 100_000
    tracemalloc.start()
    for k in range(2):
        e.known.update({f"unit{i}": (i << 8 | 1).to_bytes(6, "little") for i in range(n * k // 2, n * k // 2 + n)})
        if not k:
            e.known.age()
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    e.rest()
    after, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(e.known) == 0 and len(e.known.older) == n // 2 and e.known.older[f"unit{n - 1}"] == (n - 1 << 8 | 1).to_bytes(6, "little")
    assert peak - before < 40 * n and after < before / 2


def test_words_cost_one_call_whatever_signs_follow():
    e, asked = Encoder(PATH), []
    tokenize, of, met = e.tokenize, e.known.make, []
    e.tokenize = lambda x: asked.append(x) or tokenize(x)
    e.known.make = lambda u: met.append(u) or of(u)
    texts = ["x oddword&&& oddword, oddword oddword.!! oddword&&&", "x oddword oddword&&&"] * 40
    got = e.encode(texts)
    library = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum("oddword" in x for x in asked) == 1 and len(met) == len(set(met))
    e.encode(["never  met", "nor\n\nthis"])  # encoded whole
    assert not {"never", "met", "this"} & {*met, *e.known}


def test_readers_forget_the_encoder():
    tokenstore.encoder(PATH).encode(["some words"])
    assert list(tokenstore._checksums(iter(()))) == [] and tokenstore.encoder.cache_info().currsize == 0


def test_staged_rows_are_pages_of_their_own(spark, monkeypatch):
    """A page of many rows of 1 MB is held whole outside the heap."""
    kept = []
    monkeypatch.setattr(Workspace, "drop", lambda self, df: kept.append(df._tessella_path))
    rows = [(i, f"{i} " + "long " * 600_000) for i in range(4)]
    write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Workspace(spark, "t"), PATH)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pages = []
    for f in jvm.org.apache.hadoop.fs.Path(kept[0]).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(kept[0])):
        if f.getPath().getName().endswith(".parquet"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f.getPath(), conf))
            pages += [reader.readOffsetIndex(c).getPageCount() for b in reader.getFooter().getBlocks() for c in b.getColumns() if "payloads" in c.getPath().toDotString()]
            reader.close()
    assert sum(pages) >= len(rows)


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50000, 60000), rng.integers(0, 50000, 777)
    whole, shifted, tiny = all_cuts([60000, 60777, 5], np.concatenate((a, b, a, b[:5])))
    assert whole[-1] == len(a) and tiny == [5]
    sizes = np.diff([0, *whole])
    assert sizes[:-1].min() >= 128 and sizes.max() <= 16384 and 20 < len(whole) < 200
    assert len(set(whole) & {x - 777 for x in shifted}) > 0.8 * len(whole)
    assert all_cuts([40000], np.zeros(40000, int))[0][-1] == 40000
    assert all_cuts([1], np.zeros(1, int)) == [[1]]


def test_round_trip(spark):
    rng = random.Random(1)
    passage = " ".join(f"word{rng.randrange(999)}" for _ in range(3000))
    rows = list(enumerate(TEXTS)) + [(100 + i, f"{i} {passage}") for i in range(5)] + [(50, "long " * 60000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS root")
    at = write(df, Workspace(spark, "t"), PATH)
    assert sorted(tuple(r) for r in read_back(spark, at).collect()) == want(rows)
    library = Tokenizer.from_file(PATH)
    assert {r.doc_id: list(r.ids) for r in read_ids(spark, at).collect()} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    recipes, chunks = spark.read.parquet(at["recipes"]), spark.read.parquet(at["chunks"])
    assert chunks.count() == chunks.select("chunk").distinct().count() < recipes.selectExpr("explode(chunks)").count()
    assert spark.read.parquet(at["manifest"]).agg({"n_docs": "sum"}).first()[0] == len(rows)


def test_equal_and_null_ids_and_no_rows(spark):
    rows = [(5, "b"), (5, "a a"), (5, "a a"), (None, "first")]
    got = read_back(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), PATH)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5]
    assert got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)
    none = write(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "t"), PATH)
    assert read_back(spark, none).count() == 0


def rewritten(spark, at, name, *exprs, where="true"):
    to = f"{at[name]}-{uuid.uuid4().hex}"
    spark.read.parquet(at[name]).where(where).selectExpr(*exprs).coalesce(1).write.parquet(to)
    return {**at, name: to}


@pytest.mark.parametrize("read", [read_back, read_ids])
def test_what_is_lost_or_changed_is_found(spark, monkeypatch, read):
    monkeypatch.setattr(tokenstore, "PART", 3)
    rows = [(i, f"some text {i}") for i in range(12)]
    at = write(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), PATH)
    assert spark.read.parquet(at["manifest"]).count() > 3
    assert read(spark, at).count() == 12
    for other, what in (
        (rewritten(spark, at, "chunks", "chunk", "concat(payload, X'0000') AS payload"), "is changed"),
        (rewritten(spark, at, "chunks", "*", where="chunk <> (SELECT min(chunk) FROM parquet.`%s`)" % at["chunks"]), "is lost"),
        (rewritten(spark, at, "recipes", "*", where="doc_id <> 4"), "recipes"),
        (rewritten(spark, at, "recipes", "*", where="doc_id < 11"), "recipes"),
        (rewritten(spark, at, "recipes", "*", where="part <> 9"), "recipes"),
        (rewritten(spark, at, "recipes", "part", "CASE doc_id WHEN 3 THEN 33 ELSE doc_id END AS doc_id", "start", "n_tokens", "substring(root, 2) AS root", "chunks"), "root"),
        (rewritten(spark, at, "recipes", "part", "doc_id", "start", "n_tokens + CAST(doc_id = 2 AS INT) AS n_tokens", "root", "chunks"), "recipes"),
        (rewritten(spark, at, "manifest", "*", where="part <> (SELECT max(part) FROM parquet.`%s`)" % at["manifest"]), "no part"),
        (rewritten(spark, at, "manifest", "*", where="part <> (SELECT min(part) FROM parquet.`%s`)" % at["manifest"]), "lacks parts"),
    ):
        with pytest.raises(Exception, match=what):
            read(spark, other).collect()
    assert tokenstore.merkle([b"a", b"b"]) != tokenstore.merkle([b"b", b"a"])


def test_checksums_of_parts_join():
    rng = random.Random(4)
    parts = [rng.randbytes(rng.choice([0, 1, 4, 1000, 70001])) for _ in range(40)]
    after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
    got = shifted(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(parts))
