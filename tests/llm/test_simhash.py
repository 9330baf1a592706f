import random

import numpy as np
import pytest
import xxhash

from tessella.llm.common import Workspace
from tessella.llm.simhash import fingerprint, layouts, near_duplicates, one_of_each, trie_join, turned


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fp = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    top = dict(zip(fp, fp, strict=True))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {(i, f"{brute_fingerprint(t):016x}", root(i) if i is not None else None) for i, t in rows}


def test_fingerprint_of_short_long_and_odd_texts():
    for t in ["", "  ", "One", "A b", "a b C d", "a b c d e", "é x\ty  Z \x0b w", "x " * 70000]:
        assert fingerprint(t.encode()) == brute_fingerprint(t)
    assert fingerprint(" ".join(map(str, range(500))).encode(), step=7) == brute_fingerprint(" ".join(map(str, range(500))))


def test_trie_join_finds_the_components_of_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(13, 64, (k, 40), dtype=np.uint64), 0) for k in range(1, 8) for _ in range(4)]) & np.uint64((1 << 51) - 1))
    fp.sort()
    n = len(fp)
    got = trie_join(fp, [(0, n, 0, n)], 13, 4, most=64)
    links = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    want = np.arange(n)
    while True:
        new = np.array([want[links[i]].min() for i in range(n)])
        if (new == want).all():
            break
        want = new
    assert (got == want).all()
    left = trie_join(fp, [(0, n // 2, n // 2, n)], 13, 4)
    assert all(left[j] == left[i] for i in range(n // 2) for j in range(n // 2, n) if links[i, j])


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(None, "no id"), (7, None), (3, ""), (5, " \t")]
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 60, 400]))]
        rows.append((100 + 10 * i, " ".join(words)))
        for j in range(rng.randrange(4)):
            other = list(words)
            other[rng.randrange(len(other))] = "edit"
            rows.append((101 + 10 * i + j, "  ".join(other).upper()))
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "2 AS rep", "3 AS component")
    got = near_duplicates(df, Workspace(spark, "t"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = got.collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows)
    kept = one_of_each(df, Workspace(spark, "t"))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows)}


def test_hot_block_is_dealt_in_chunks(spark, monkeypatch):
    from tessella.llm import simhash

    monkeypatch.setattr(simhash, "LIMIT", 5)
    rows = [(i, " ".join(f"t{k}" for k in range(300)) + f" {i}") for i in range(60)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("n", [10, 10**9, 10**12])
def test_close_fingerprints_agree_in_the_first_bits_of_a_layout(n):
    rng = random.Random(2)
    made = layouts(n)
    assert len(made) == {10: 5, 10**9: 15, 10**12: 70}[n]
    for order, first in made:
        assert sorted(b for at, k in order for b in range(at, at + k)) == list(range(64)) and first >= {10: 12, 10**9: 20, 10**12: 32}[n]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(int(turned(x, o)[0]) >> (64 - f) == int(turned(y, o)[0]) >> (64 - f) for o, f in made)
        assert int(turned(x, made[0][0])[0]) == a


@pytest.mark.parametrize("blocks", [6, 8])
def test_more_blocks_find_the_same(spark, monkeypatch, blocks):
    from tessella.llm import simhash

    real = simhash.layouts
    monkeypatch.setattr(simhash, "layouts", lambda n, limit: real({6: 10**9, 8: 10**12}[blocks]))
    rows = [(i, " ".join(f"t{k}" for k in range(120)) + f" {i % 20}") for i in range(40)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("text", ["doc_id long, text string"])
def test_empty(spark, text):
    assert near_duplicates(spark.createDataFrame([], text), Workspace(spark, "t")).count() == 0


def test_one_row_of_repeated_rows_and_null_ids_stays(spark):
    rows = [(4, "the same text of some words"), (4, "the same text of some words"), (9, "The same  text of some words"), (None, "the same text of some words")]
    rows += [(None, "a text without an id here"), (None, "a text without an id here"), (5, "another one")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == ["4", "5", "None"]
