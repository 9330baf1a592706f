import random
from collections import Counter

import corpus_pipeline
from tessella.llm.common import Workspace, read
from tessella.llm.linededup import drop_lines
from tessella.llm.mixing import mix, mixed_documents, schedule, taken, targets


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices({"en": ["the", "and", "ing"], "de": ["sch", "ung", "ß"]}[k], k=3))
    rows = []
    for i in range(300):
        k = rng.choice(["en", "de"])
        rows.append((i, " ".join(word(k) for _ in range(rng.choice([30, 200]))) + "\nSame footer", k, rng.choice(["a", "a", "b", "c"])))
    rows += [(300 + i, rows[i][1] + " x", rows[i][2], "b") for i in range(40)] + [(900, None, "en", "a"), (901, "123", "de", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 AS _key", "'x' AS n_dropped", "2 AS _drop", "3 AS _id", "4 AS _copies", "5 AS _gone", "6 AS size", "7 AS slot", "8 AS ambiguous", "9 AS bin", "10 AS shard")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = read(spark, str(tmp_path), "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = Workspace(spark, "t").save(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        kept.append(out)
        docs = out
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert ids[0] == set(range(340))
    assert ids[1] == ids[0] and kept[1].where("text LIKE '%footer%'").count() == 0
    assert ids[2] == set(range(300))
    words = {r.doc_id: len(r.text.split()) for r in kept[2].collect()}
    copies = Counter(r.doc_id for r in kept[3].select("doc_id").collect())
    assert max(copies.values()) == 2
    packed = Counter()
    for r in kept[4].collect():
        packed[r.doc_id] += r.size
    assert packed == {i: n * words[i] for i, n in copies.items()}
    mixed = sum(words[i] * n for i, n in copies.items())
    assert abs(mixed - 1.5 * sum(words.values())) < 0.1 * sum(words.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_mixing_takes_blocks_of_the_schedule(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), rng.choice(["a", "b", "b", None])) for i in range(500)]
    rows += [(600, None, "a"), (601, " \n ", "z"), (None, "x y", "b"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS slot")
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    got = taken(df, Workspace(spark, "t"), block=64).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.target, r.source_size] += r.taken
    for (target, source_size), n in by.items():
        assert abs(n - target) <= 2 * 64 and n <= 2 * source_size >= target
    pieces = mix(df, Workspace(spark, "t"), block=64).where("slot IS NOT NULL").collect()
    slots, words = Counter(), Counter()
    for r in pieces:
        slots[r.slot] += r.words
        words[r.doc_id, r.size, r.at] += r.words
    assert max(slots.values()) == 64 and sum(n == 64 for n in slots.values()) > 0.9 * len(slots)
    total = round(1.5 * sum(size.values()) / 64)
    assert set(slots) <= set(range(total)) and len(slots) >= total - 3
    assert sum(words.values()) == sum(r.taken for r in got)
    assert {tuple(r) for r in taken(df, Workspace(spark, "t"), block=64).collect()} == {tuple(r) for r in got}
    assert taken(df.limit(0), Workspace(spark, "t")).count() == 0
    whole = Counter(r.doc_id for r in mixed_documents(df, Workspace(spark, "t")).collect())
    assert max(n for i, n in whole.items() if i != 0) == 2


def test_blocks_without_a_slot_are_not_taken(spark, monkeypatch):
    """The schedule alone decides what is taken."""
    from tessella.llm import mixing

    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(50)], "doc_id long, text string, source string")
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).where("k % 2 = 0"))
    assert sum(r.taken for r in taken(df, Workspace(spark, "t"), block=10).collect()) == 380
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).limit(0))
    assert {r.taken for r in taken(df, Workspace(spark, "t"), block=10).collect()} == {0}


def test_schedule_is_even(spark):
    sources = targets(spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "source string, size long"))
    by = {r.source: r.target for r in sources.collect()}
    assert by == {"a": 2000.0, "b": 2000.0, "c": 500.0} or abs(sum(by.values()) - 4500) < 1e-6
    got = schedule(spark, sources, 900).collect()
    for lo in range(0, 900, 90):
        part = Counter(r.idx for r in got if lo <= r.slot < lo + 90)
        assert all(abs(part[i] - 90 * by[s] / 4500) <= 3 for i, s in enumerate("abc"))
    for i in range(3):
        assert sorted(r.k for r in got if r.idx == i) == list(range(sum(r.idx == i for r in got)))


def test_line_dedup_odd_cases(spark):
    rows = [(i, "h", f"own {i}\n  footer \n\nfooter") for i in range(20)] + [(20 + i, None, f"no host {i}\nnav") for i in range(20)]
    rows += [(70 + i, "h", "copied page") for i in range(30)]
    rows += [(40, "h", None), (41, "h", ""), (42, "lone", "a\na"), (43, "few", "x\nfooter"), rows[0]]
    rows += [(50 + i, "small", f"page {i}\nmenu" + "\npair" * (i < 2)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").selectExpr("*", "1 AS _h", "2 AS _pages", "3 AS _key", "4 AS _keep", "'x' AS n_lines")
    out = drop_lines(df, Workspace(spark, "t"))
    assert out.columns == ["page_id", "host", "text", "_h", "_pages", "_key", "_keep", "n_lines", "n_dropped"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[3].text, by[3].n_lines, by[3].n_dropped) == ("own 3\n", 4, 2)
    assert by[21].text == "no host 1" and by[75].text == "copied page"
    assert (by[40].text, by[40].n_lines) == (None, 0) and by[41].text == ""
    assert by[42].text == "a\na" and by[43].text == "x\nfooter"
    assert by[50].text == "page 0\npair" and by[53].text == "page 3"
    assert drop_lines(df.limit(0), Workspace(spark, "t")).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"h{i % 9}"]), "\n".join(rng.choice([f"line {rng.randrange(12)}", f" line {rng.randrange(4)}\t", "", f"own {i}"]) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += rows[:20]
    pages = {}
    for _, h, t in rows:
        pages.setdefault(h, set()).add(t)
    on = {h: Counter(x for t in texts for x in {y.strip(" \t\n\x0b\x0c\r") for y in t.split("\n")} - {""}) for h, texts in pages.items()}
    want = sorted((str(i), "\n".join(x for x in t.split("\n") if not (on[h][x.strip()] >= 3 and on[h][x.strip()] > 0.1 * len(pages[h])))) for i, h, t in rows)
    got = drop_lines(spark.createDataFrame(rows, "page_id long, host string, text string"), Workspace(spark, "t"))
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == want


def test_lines_of_white_space_are_read_in_time(spark):
    import time

    df = spark.createDataFrame([(1, "h", "x" + " " * 1_000_000 + "y\n" + " " * 1_000_000)], "page_id long, host string, text string")
    began = time.monotonic()
    assert drop_lines(df, Workspace(spark, "t")).first().n_lines == 2
    assert time.monotonic() - began < 30


def test_line_dedup_stage_cleans_small_sources(spark):
    rows = [(i, f"own {i}" + "\nfooter" * (i < 4) + "\ntwice" * (i < 2), "small") for i in range(8)]
    rows += [(100 + i, f"own {i}" + "\nfooter" * (i < 9) + "\nrare" * (i < 3), "middle") for i in range(40)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {i: t.replace("\nfooter", "") for i, t, _ in rows}
