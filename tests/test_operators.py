import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import scalar as S
from quarrylight.operators import batches, delta, graph, retention, rollup, search, summaries, taint
from quarrylight.sources import llm_client
from quarrylight.streaming import debounce


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    p = lambda s: S.normal_path(F.lit(s))
    assert one(spark, p("a/./b/../c")) == "a/c" and one(spark, p("../../x")) == "x" and one(spark, p("/a//b")) == "a/b"
    assert one(spark, S.path_prefixes(F.lit("a/b/c.py"))) == ["a", "a/b"] and one(spark, S.path_prefixes(F.lit("c.py"))) == []
    assert one(spark, S.path_parent(F.lit("c.py"))) == "." and one(spark, S.path_suffix(F.lit("a.b/c.tar.gz"))) == ".gz"
    assert one(spark, S.json_list(F.lit("[\"a\"]"))) == ["a"] and one(spark, S.json_list(F.lit("bad"))) == []
    assert one(spark, S.stripped_answer(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, S.patched(F.lit(""), F.lit("old"))) == "old"
    assert one(spark, S.decayed(F.lit(1.0))) == pytest.approx(0.85) and one(spark, S.token_estimate(F.lit("abcdefg"))) == 1
    tags = [one(spark, S.confidence_tag(F.lit(c))) for c in (0.1, 0.2, 0.49, 0.5)]
    assert tags == ["LIKELY STALE", "LOW CONFIDENCE", "LOW CONFIDENCE", ""]
    assert one(spark, S.source_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"


def test_centrality(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    got = dict(values(graph.seeded_centrality(nodes, edges, "a")))
    score = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(5):
        score = {"a": 0.05, "b": 0.05 + 0.85 * score["a"] / 2, "c": 0.05 + 0.85 * (score["a"] / 2 + score["b"])}
    assert got == pytest.approx(score)
    lone = graph.seeded_centrality(spark.createDataFrame([("x",)], "node string"), edges.filter("false"), "x")
    assert values(lone)[0][1] == pytest.approx(0.15)
    absent = graph.seeded_centrality(nodes, edges, "zz", iterations=0)
    assert {r[1] for r in values(absent)} == {1 / 3}


def test_taint(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "B2"), ("B", "B"), ("X", "A"), ("X", "A")], "caller_id string, callee_id string")
    changed = spark.createDataFrame([("B",), ("B2",)], "id string")
    assert values(taint.one_hop_taint(changed, edges), "caller_id") == [("A", "B2", 2), ("B", "B", 2)]
    old, new = spark.createDataFrame([("A",), ("B",)], "id string"), spark.createDataFrame([("A",)], "id string")
    assert values(taint.removed_taint(old, new, edges)) == [("A", "B", 2)]


def test_delta(spark):
    old = spark.createDataFrame([(1, "c", "s", 1.0, False, "old", "t"), (2, "c", "s", 0.5, False, "old", "t"), (3, "c", "s", 1.0, False, "old", "t")], "id int, c string, s string, confidence double, is_stale boolean, purpose string, updated_at string")
    new = spark.createDataFrame([(1, "c", "s"), (2, "c2", "s2"), (4, "c", "s")], "id int, c string, s string")
    status = dict((r.id, r.status) for r in delta.hash_diff(old, new, "id", "c", "s").collect())
    assert status == {1: "unchanged", 2: "changed", 3: "removed", 4: "new"}
    out = {r.id: r for r in delta.carry_over(old, new, "id", "s", ["purpose"], F.lit("now")).collect()}
    assert (out[1].confidence, out[1].is_stale, out[1].purpose) == (1.0, False, "old")
    assert out[2].confidence == pytest.approx(0.425) and out[2].is_stale and out[2].purpose == "old"
    assert (out[4].confidence, out[4].is_stale, out[4].purpose) == (1.0, True, None)
    hits = delta.cache_hits(spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5), (3, 1.0, 5)], "p int, m double, s long"), spark.createDataFrame([(1, 1.005, 5), (2, None, 5)], "p int, m double, s long"), "p", "m", "s")
    assert values(hits, "p") == [(1, True), (2, False), (3, False)]


def test_retention(spark):
    rows = [("f", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(25)] + [("g", 99, None)]
    df = spark.createDataFrame(rows, "file string, id int, ts timestamp")
    kept = retention.latest_per_key(df, "file", "ts", "id", 20)
    assert kept.filter("file = 'f'").count() == 20 and kept.filter("file = 'f'").agg(F.min("id")).first()[0] == 5
    assert [r.id for r in retention.latest(df, "ts", "id", 2).collect()] == [24, 23]


def test_rollup(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",), ("c/q.py",)], "path string")
    assert dict(values(rollup.directory_rollup(files))) == {".": 4, "a": 2, "a/b": 1, "c": 1}
    tree = values(rollup.folded_tree(files, "a/y.py"), "kind", "entry")
    assert tree == [("file", "a/y.py (TARGET)"), ("folder", "c/ [1 files]")]


def test_batches(spark):
    sizes = [30, 50, 30, 200, 10] + [1] * 25
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, t long")
    got = [r.batch for r in batches.greedy_batches(df, "g", "i", F.col("t"), 20, 100).orderBy("i").collect()]
    want, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n >= 20 or (n and total + s > 100):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        want.append(batch)
    assert got == want
    page = spark.createDataFrame([("f", i * 10, i * 10 + 5) for i in range(35)], "file string, a int, b int")
    rows = batches.page_rows(page, "file", "a", "b", 333).orderBy("pos").collect()
    assert len(rows) == 20 and rows[0].a == 330 and rows[1].a == 0 and rows[0].total == 35


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha beta gamma"), (3, "gamma"), (4, None)], "id int, t string")
    assert [r.id for r in search.bm25(docs, "alpha beta", "id", ["t"]).collect()] in ([1, 2], [2, 1])
    assert search.bm25(docs, "alpha AND zeta", "id", ["t"]).count() == 0 and search.bm25(docs, "...", "id", ["t"]).count() == 0
    assert [r.id for r in search.contains(spark.createDataFrame([(1, "50%_x"), (2, "50ax")], "id int, t string"), "50%_X", ["t"]).collect()] == [1]


def test_answers(spark):
    df = spark.createDataFrame([('```json\n[{"path": "a", "purpose": "p"}]\n```',), ("",), ("nope",)], "answer string")
    rows = summaries.parsed_answers(df).collect()
    assert [r.error for r in rows] == [None, "empty answer", "not a JSON list"] and rows[0].path == "a"
    calls = []

    class Busy(Exception):
        status = 503

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise Busy
        return "ok"

    waits = []
    assert llm_client.with_retry(flaky, "p", sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        llm_client.with_retry(lambda p: (_ for _ in ()).throw(ValueError()), "p", sleep=waits.append)
    assert llm_client.choose_model(["b:1", "a"], ["a", "b"]) == "a" and llm_client.choose_model(["a"], ["a"], "z") is None


def test_debounce(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "a.py", False), (t + dt.timedelta(seconds=1), "b.py", False), (t + dt.timedelta(seconds=2), "a.py", False), (t + dt.timedelta(seconds=9), "c.PY", False), (t, "d", True), (t, "e.txt", False)]
    events = spark.createDataFrame(rows, "ts timestamp, path string, is_directory boolean")
    kept = debounce.event_filter(events, [".py"])
    assert values(debounce.sessions(kept, "ts", "path", "2 seconds", []).select("n_events", "paths"), "n_events") == [(1, ["c.PY"]), (3, ["a.py", "b.py"])]
    seen = spark.createDataFrame([("a", False, None, None), ("b", True, "c", "s"), ("c", True, "x", "s"), ("d", True, "x", "y"), ("e", True, "x", "y")], "path string, exists boolean, content_hash string, semantic_hash string")
    index = spark.createDataFrame([(p, "c", "s") for p in "abcd"], "path string, content_hash string, semantic_hash string")
    assert [r.action for r in debounce.classify(seen, index).orderBy("path").collect()] == ["deleted", "unchanged", "formatting", "reindex", "ignored"]


def test_bm25_from_postings_agrees(spark):
    docs = spark.createDataFrame([(1, "the cat the dog", "x"), (2, "Cat", None), (3, None, None), (4, "dog dog cat", "cat"), (5, "bird", "the")], "k int, text string, more string")
    index = search.postings(docs, "k", ["text", "more"])
    for q in ("cat", "the cat", "dog cat", "zebra", "", "c-a-t"):
        want = [tuple(r) for r in search.bm25(docs, q, "k", ["text", "more"]).collect()]
        assert [tuple(r) for r in search.bm25_indexed(index, q, "k").collect()] == want, q


def test_islands_do_not_cut_sessions(spark):
    import random

    rng = random.Random(3)
    times = sorted(rng.choice([0, 500, 503, 9000, 30_000]) + rng.randrange(0, 400) for _ in range(200))
    df = spark.createDataFrame([(t, f"p{i % 7}") for i, t in enumerate(times)], "t long, path string").selectExpr("timestamp_seconds(t) AS ts", "path")
    got = sorted((r.n_events, r.first_seen.timestamp()) for r in debounce.sessions(df, "ts", "path", "10 seconds", []).collect())
    want, n, first, last = [], 0, None, None
    for t in times:
        if last is not None and t - last > 10:
            want.append((n, float(first)))
            n, first = 0, None
        n, first, last = n + 1, t if first is None else first, t
    want.append((n, float(first)))
    assert got == sorted(want)


def test_candidates_of_common_names_are_the_first(spark):
    rows = [(f"f{i:03d}", "common") for i in range(300)] + [("a", "one"), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "id string, name string").repartition(5)
    got = {r.name: r for r in graph.by_unique_name(df, "id", "name").collect()}
    assert got["common"].candidates == [f"f{i:03d}" for i in range(5)] and got["common"].n_matches == 300 and got["common"].target is None
    assert got["one"].target == "a" and got[None].candidates == ["b", "c"] and got[None].is_ambiguous
