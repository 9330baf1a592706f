import random

import corpus_pipeline
from tessella.llm.common import Workspace, among, numbered
from tessella.llm.jaccard import different, shingles


def brute(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_dedup_stage_finds_pairs_of_similarity_point_8(spark):
    rng = random.Random(5)
    rows, gone, stay = [], set(), {2000, 2001, 2003}
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for k in rng.sample(range(10, 190, 12), 3 + i % 5):
            other[k] = f"edit{k}"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, "  ".join(other).upper())]
        a, b = brute(rows[-2][1]), brute(rows[-1][1])
        gone |= {10 * i + 1} if len(a & b) >= 0.8 * len(a | b) else set()
        stay |= {10 * i}
    assert 20 < len(gone) < 60
    rows += [(2000, ""), (2001, "a b"), (2002, "A  b"), (2003, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
    assert stay <= got and not gone & got and 2002 not in got
    assert len(got - stay) > 0
    assert len(shingles(b"a b c d e a b c d e a")) == 5 and len(shingles(b"")) == 0


def test_buckets_of_the_same_documents_are_compared_once(spark):
    members = {1: (1, 2), 2: (1, 2), 3: (1, 2, 3), 4: (2, 3), 5: (3, 2), 6: (4, 1), 7: (1, 2)}
    met = spark.createDataFrame([(n, 1, h) for h, nodes in members.items() for n in nodes], "node long, group long, head long")
    left = {}
    for r in different(met).collect():
        left.setdefault(r["head"], set()).add(r.node)
    assert sorted(map(sorted, left.values())) == [[1, 2], [1, 2, 3], [1, 4], [2, 3]]


def test_rows_among_others_stay_where_they_are(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(0, 5000, 1, 7).selectExpr("id AS doc_id", "'x' AS _told", "concat('text ', id) AS text")
        rows = numbered(docs, Workspace(spark, "t"), "_row", "_bucket")
        some = rows.where("doc_id % 3 = 0").select("_row")
        for there, want in ((True, {i for i in range(5000) if i % 3 == 0}), (False, {i for i in range(5000) if i % 3})):
            got = among(rows, "_row", "_bucket", some, there)
            assert {r.doc_id for r in got.collect()} == want and got.count() == len(want) and got.columns == rows.columns
            plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "ShuffledHashJoin" in plan and "hashpartitioning(_bucket" not in plan and "hashpartitioning(_row" not in plan
        none = among(rows, "_row", "_bucket", some.where("false"))
        assert none.count() == 0 and among(rows, "_row", "_bucket", some.where("false"), False).count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
