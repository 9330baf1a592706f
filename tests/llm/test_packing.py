import random
from collections import Counter, defaultdict

from tessella.llm.common import Workspace
from tessella.llm.packing import best_fit, pack, same_text


def brute(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for s, src, c in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(x[0] for x in b) - s, i) for i, b in enumerate(bins)
                if sum(x[0] for x in b) + s <= capacity and (c is None or all(x[2] != c for x in b)) and (src is None or sum(x[1] == src for x in b) < per_source)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((s, src, c))
        out.append(i)
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(0, 120)
        sizes = sorted((rng.randint(1, 40) for _ in range(n)), reverse=True)
        sources = [rng.choice(["a", "a", "b", None]) for _ in range(n)]
        clusters = [rng.choice([1, 1, 1, 2, 3, None, *range(9, 40)]) for _ in range(n)]
        assert best_fit(sizes, sources, clusters, 40, 3) == brute(sizes, sources, clusters, 40, 3)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 300)) if i % 3 else "Hot  copy of a text", rng.choice(["s", "t", None])) for i in range(600)]
    rows += [(1000, None, "s"), (1001, " ", "t"), (1002, "long " * 2500, None), (None, "no id", "s"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS shard", "2 AS bin", "3 AS size")
    got = pack(df, same_text(), Workspace(spark, "t"), capacity=1000, per_source=4, shard=100).collect()
    by = defaultdict(list)
    for r in got:
        if r.bin:
            by[r.bin].append(r)
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    have = Counter()
    for r in got:
        have[r.doc_id] += r.size
    assert have == want
    for pieces in by.values():
        pieces.sort(key=lambda r: r.at)
        end = 0
        for r in pieces:
            assert r.at == end
            end += r.size
        assert end <= 1000
        assert max(Counter(r.cluster for r in pieces).values()) == 1
        assert max(Counter(r.source for r in pieces if r.source).values(), default=0) <= 4
    assert {r.doc_id for r in got if r.bin is None} == {1000, 1001}
    assert pack(df.limit(0), same_text(), Workspace(spark, "t")).count() == 0
