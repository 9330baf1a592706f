import numpy as np
import pytest

from tessella.llm import embeddings
from tessella.llm.common import Workspace
from tessella.llm.embeddings import buckets, codes, near_vectors, quantiser, tables, unit

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [j for k, (j, w) in enumerate(good) if k != m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9] for m, (i, v) in enumerate(good)}
    out = {}
    for i, v in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen) if i is not None else None)
    return out


def planted(n=300, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = x[rng.integers(0, n, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.15], (n, 1))
    return np.concatenate((x, near, x[:20] * 3, np.repeat(x[:1], 70, 0), x[1] + rng.normal(size=(90, dim)) * 0.02)).astype(np.float32)


@pytest.mark.parametrize("limit", [2048, 20])
def test_near_vectors_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(embeddings, "LIMIT", limit)
    monkeypatch.setattr(embeddings, "SMALL", 10)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(planted())]
    odd = [(10001, None), (10002, [0.0] * 64), (10003, [None] + [1.0] * 63), (10004, [float("nan")] * 64), (10005, [float("inf")] * 64), (10006, []), (None, rows[0][1]), (10007, [1.0, 2.0]), (10008, [1.1, 2.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS n", "2 AS rep", "3 AS label")
    got = near_vectors(df, Workspace(spark, "t")).collect()
    want = brute(rows + odd)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id or r.vec_id is None)


def recall(a, b, q, n):
    x, y = codes(a, q), codes(b, q)
    made = tables(n)
    return ((buckets(x, made) == buckets(y, made)).any(1) & (np.bitwise_count((x ^ y).view(np.uint64)) <= embeddings.HAMMING)).mean()


def pairs(a, cosine, rng):
    noise = rng.normal(size=a.shape)
    noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    return cosine * a + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize("dim", [16, 64, 384, 768])
def test_recall_near_the_threshold(dim):
    rng = np.random.default_rng(4)
    q = quantiser(unit(rng.normal(size=(4000, dim))))
    a = unit(rng.normal(size=(3000, dim)))
    for cosine, least in ((0.9, 0.91), (0.95, 0.97)):
        assert recall(a, pairs(a, cosine, rng), q, 1000) >= least
    for n in (10**7, 10**8):
        assert recall(a, pairs(a, 0.9, rng), q, n) >= 0.9
        assert all(len(set(t)) == n.bit_length() - 10 for t in tables(n))


def test_recall_on_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 128)) * np.linspace(3, 0.2, 128)
    data = unit(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 128)) * 0.7)
    q = quantiser(data[:4000])
    assert recall(data[4000:], pairs(data[4000:], 0.9, rng), q, 1000) >= 0.9


def test_doubles_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (2, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[:2] for r in near_vectors(df, Workspace(spark, "t")).collect()) == [(1, 1), (2, 0), (2, 1)]
    assert near_vectors(df.limit(0), Workspace(spark, "t")).count() == 0
