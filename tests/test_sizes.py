"""What differs only on larger tables: rounding, skewed keys, parallel work."""

import datetime as dt

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarrylight.operators import batches, graph, imports, intervals, seeds, segments, trigrams
from quarrylight.plans import catalog, code_catalog
from quarrylight.scratch import settle
from quarrylight.sources import extract
from quarrylight.streaming import debounce, processor

DATA = "/root/testdata/sf0.001"


def test_events_at_the_edges_of_intervals(spark, tmp_path):
    """epoch_ms rounds microseconds to the nearest millisecond."""
    zero = dt.datetime(2024, 1, 1)
    order = 3  # from second 111 to second 171
    events = [(i, zero + dt.timedelta(seconds=s, microseconds=u)) for i, (s, u) in enumerate([(110, 999_499), (110, 999_500), (111, 0), (171, 400), (171, 500), (171, 499), (110, 999_600)])]
    spark.createDataFrame([(order,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE["events_in_intervals"]).fetchall()
    assert want == [(order, 5, 1, 6)]
    got = catalog.QUERIES["events_in_intervals"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == want


def test_intervals_are_summed_up_without_a_row_for_each_point(spark, monkeypatch):
    """Any cut into slabs and shares gives what all pairs give: with empty and
    turned intervals, nulls, points at one place and a key with two intervals."""
    points = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, id * 7919 % 2003 - 500) AS at", "IF(id % 9 = 0 OR id * 7919 % 2003 = 77, NULL, id * 31 % 2999) AS v")
    points = points.unionByName(spark.range(400).selectExpr("40L AS at", "id AS v"))
    spans = spark.range(1500).selectExpr("IF(id % 97 = 0, NULL, id % 1490) AS k", "id * 37 % 2500 - 700 AS s", "id * 37 % 2500 - 700 + CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN id % 40 ELSE id END AS e")
    spans = spans.unionByName(spark.createDataFrame([(2001, -423, -423), (2002, 5000, 9000), (2003, -9000, -600), (2004, None, 3), (2005, -9000, 9000)], "k long, s long, e long"))
    pairs = intervals.contained(points, spans, "at", "s", "e").groupBy("k").agg(F.count("*"), F.min("v"), F.max("v"))
    want = sorted(map(tuple, pairs.collect()), key=str)
    assert any(r[0] == 2001 and r[2] is None for r in want)
    for slab, share in ((1 << 15, 250_000), (100, 30), (1, 700)):
        monkeypatch.setattr(intervals, "SLAB", slab)
        monkeypatch.setattr(intervals, "SHARE", share)
        out = intervals.summaries(points, spans, "at", "v", "k", "s", "e")
        assert sorted(map(tuple, out.collect()), key=str) == want
        assert plan_of(out).count("Join ") == 1  # of slabs and their shares
    assert intervals.summaries(points.filter("false"), spans, "at", "v", "k", "s", "e").count() == 0
    assert intervals.summaries(points, spans.filter("false"), "at", "v", "k", "s", "e").count() == 0


def test_files_of_a_small_table_are_read_by_several_tasks(spark):
    """A customer is a file, and all customers lie in one small Parquet file."""
    for language in code_catalog.EXTENSION:
        assert code_catalog.customer_files(spark, DATA, language).rdd.getNumPartitions() >= 4
    assert catalog.source_files(spark, DATA).rdd.getNumPartitions() >= 4


def test_what_is_not_wanted_is_not_made():
    for language, text in code_catalog.TEMPLATE.items():
        text = text.replace("{n}", "1").replace("{k}", "2")
        whole = extract.extract_one("a", language, text.encode())
        bare = extract.extract_one("a", language, text.encode(), extract.pruned(hashes=False, functions=True))
        assert whole["functions"] and bare == whole | {"semantic_hash": None, "functions": [f | {"semantic_hash": None} for f in whole["functions"]]}
        assert extract.extract_one("a", language, text.encode(), extract.pruned(hashes=False, functions=False)) == whole | {"semantic_hash": None, "functions": []}


def test_imports_that_many_files_share_are_resolved_once(spark, monkeypatch):
    seen = []
    plain = imports.candidate_paths
    monkeypatch.setattr(imports, "candidate_paths", lambda rows: seen.append(rows.count()) or plain(rows))
    one = lambda module, names, level: {"module": module, "names": names, "level": level, "alias": None}
    files = [(f"a/{d}/f{i}.py", "python", ["x"], [one("", ["g"], 1), one("lib.os", [], 0), one("up", [], 2)]) for d in "bc" for i in range(40)]
    files += [(f"a/{d}/g.py", "python", [], []) for d in "bc"] + [("a/up.py", "python", [], []), ("lib/os.py", "python", [], [])]
    files += [(f"src/r/m{i}.rs", "rust", ["open"], [one("super::util", ["open"], 0), one("super::super", ["top"], 0)]) for i in range(40)]
    files += [("src/r/util.rs", "rust", ["open"], []), ("src/top/mod.rs", "rust", [], []), ("src/r/deep/mod.rs", "rust", [], [one("super::util", ["open"], 0)])]
    df = spark.createDataFrame(files, "path string, language string, exports array<string>, imports_raw array<struct<module:string,names:array<string>,level:int,alias:string>>")
    got = {(r.src, r.dst) for r in imports.resolve(df).collect()}
    want = {(f"a/{d}/f{i}.py", dst) for d in "bc" for i in range(40) for dst in (f"a/{d}/g.py", "a/up.py", "lib/os.py")}
    want |= {(f"src/r/m{i}.rs", "src/r/util.rs") for i in range(40)} | {("src/r/deep/mod.rs", "src/r/util.rs")}
    want |= {(f"src/r/m{i}.rs", "src/top/mod.rs") for i in range(40)}
    assert got == want
    assert seen == [7]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_bring_no_more_than_their_least_values(spark, monkeypatch):
    seen = []
    plain = graph.first_rule
    monkeypatch.setattr(graph, "first_rule", lambda *rules, **o: seen.extend(r.groupBy("k").count().agg(F.max("count")).first()[0] for r in rules) or plain(*rules, **o))
    catalog.QUERIES["rule_cascade"](spark, DATA)
    assert len(seen) == 3 and all((n or 0) <= 1 for n in seen)


def test_chunks_of_one_group_share_no_join_key(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(batches, "settle", lambda df, name: plans.append((name, plan_of(df))) or settle(df, name))
    rows = spark.range(200).selectExpr("IF(id < 190, 0, 1) AS g", "id AS o", "id % 5 AS t")
    out = batches.greedy_batches(rows, "g", "o", F.col("t"), 4, 9, 16)
    want, n, total = 0, 0, 0
    for t in (i % 5 for i in range(190)):
        if n == 4 or n and total + t > 9:
            want, n, total = want + 1, 0, 0
        n, total = n + 1, total + t
    assert out.filter("g = 0").agg(F.max("batch")).first()[0] == want
    assert [n for n, _ in plans][:2] == ["batches", "batches-maps"] and "Join" not in plans[1][1]


def test_one_session_of_all_events_is_no_task_of_all_events(spark):
    rows = [(t, p) for t, p in [(0, "a"), (600_000_000, "b"), (1_200_000_001, "a"), (1_200_000_001, "c"), (1_799_999_999, "b"), (2_399_999_999, None), (9_000_000_000, "d")]]
    df = spark.createDataFrame([*rows, (None, "x")], "at long, path string").select(F.timestamp_micros("at").alias("ts"), "path")
    out = debounce.sessions(df, "ts", "path", "10 minutes", [])
    got = sorted((r.at, r.n_events, r.paths) for r in out.withColumn("at", F.unix_micros("first_seen")).collect())
    assert got == [(0, 2, ["a", "b"]), (1_200_000_001, 4, ["a", "b", "c"]), (9_000_000_000, 1, ["d"])]
    assert "session" not in plan_of(out).lower()


def test_many_seeds_over_several_blocks(spark, monkeypatch):
    """What moves between tasks are sums a seed and node, in blocks of any size."""
    monkeypatch.setattr(seeds, "EDGES", 150)
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(700).selectExpr("(id * 7 + id * id % 11) % 60 AS src", "(id * 13 + id * id % 17) % 60 AS dst")
    some = nodes.filter("node % 9 = 0")
    got = {(r.seed, r["rank"]): (r.node, round(r.score, 9)) for r in graph.best_centralities(nodes, edges, some, 4).collect()}
    for seed in (0, 27, 54):
        want = {r.node: round(r.score, 9) for r in graph.seeded_centrality(nodes, edges, seed).collect()}
        best = sorted(want, key=lambda n: (-want[n], n))[:4]
        assert [got[seed, k + 1] for k in range(4)] == [(n, want[n]) for n in best]
    assert len(got) == 28


def test_seeds_of_a_small_graph_move_only_their_best(spark, monkeypatch):
    """Neither a round's scores nor blocks of edges are written."""
    written, settled = [], lambda df, name: written.append(name) or settle(df, name)
    monkeypatch.setattr(seeds, "settle", settled)
    monkeypatch.setattr(graph, "settle", settled)
    nodes = spark.range(300).select(F.col("id").alias("node"))
    edges = spark.range(4000).selectExpr("(id * 7 + id * id % 11) % 290 AS src", "(id * 13 + id * id % 17) % 310 AS dst")
    some = nodes.filter("node % 9 = 0 OR node = 295")
    shown = lambda: sorted((r.seed, r["rank"], r.node, round(r.score, 9)) for r in graph.best_centralities(nodes, edges, some, 4).collect())
    for go in (seeds.GO, 50):
        written.clear()
        monkeypatch.setattr(seeds, "GO", go)
        got = shown()
        assert "seeds" not in written and "edges" not in written and len(got) == 35 * 4
    monkeypatch.setattr(seeds, "HELD", 0)
    monkeypatch.setattr(seeds, "EDGES", 900)
    assert shown() == got and "seeds" in written


def test_scores_that_are_equal_when_rounded_go_by_number():
    score = np.array([0.3, 0.1 + 4e-10, 0.1, 0.1 + 3e-10, 0.1 - 2e-10, 0.05, 0.3, 0.1 + 5e-10])
    idx, _ = seeds.leading(np.arange(8)[::-1], score, 3)
    assert sorted(idx.tolist()) == [0, 1, 3, 7]  # 0 lies between two decimals
    assert len(seeds.leading(np.arange(1000), np.full(1000, 0.1), 3)[0]) == 3


def test_texts_of_one_file_are_indexed_and_searched_by_several_tasks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = trigrams.TrigramIndex(docs, "doc_id", ["text", "source"])
    assert len(index.docs.inputFiles()) >= 4
    found = index.search("ING the")
    want = docs.filter("contains(lower(text), 'ing the') OR contains(lower(source), 'ing the')")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    # The texts are neither moved nor looked at before it is known where to look.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CASE WHEN (getbit" in plan


class Handle:
    """State of one key in memory; counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.far, self.held = 0, set(), {}, None

    def count(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, name, schema):
        outer = self

        class Value:
            exists = lambda _: outer.count(outer.held is not None)
            get = lambda _: outer.count(outer.held)
            update = lambda _, v: outer.count(setattr(outer, "held", v))
            clear = lambda _: outer.count(setattr(outer, "held", None))

        return Value()

    def getMapState(self, name, key, value):
        outer = self

        class Map:
            containsKey = lambda _, k: outer.count(k in outer.far)
            getValue = lambda _, k: outer.count(outer.far.get(k))
            updateValue = lambda _, k, v: outer.count(outer.far.update({k: v}))
            clear = lambda _: outer.count(outer.far.clear())

        return Map()

    def registerTimer(self, at):
        self.count(self.timers.add(at))

    def deleteTimer(self, at):
        self.count(self.timers.discard(at))

    def listTimers(self):
        return self.count(sorted(self.timers))


def test_all_bursts_that_are_over_go_out_at_once(spark):
    """A key costs a fixed number of calls, however many bursts it has."""
    from types import SimpleNamespace

    quiet, handle, second = processor.QuietPaths(60, 86400), Handle(), 1_000_000
    quiet.init(handle)
    at = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)

    def fire(mark):
        out = []
        for t in sorted(t for t in handle.timers if t <= mark):
            out += quiet.handleExpiredTimer(("k",), at(mark), SimpleNamespace(getExpiryTimeInMs=lambda: t))
            handle.timers.discard(t)
        return out

    rows = [SimpleNamespace(at=i * 1000 * second, path=f"p{i % 300}", state=str(i // 600)) for i in range(900)]
    assert list(quiet.handleInputRows(("k",), iter(rows), at(0))) == []
    assert len(handle.timers) == 1 and handle.calls <= 3
    first = fire(99_100_000)
    assert [(r.first_seen, r.n_events, r.paths) for r in first] == [(i * 1000 * second, 1, [f"p{i}"]) for i in range(100)]
    assert handle.calls <= 10 and len(handle.timers) == 1
    out = first + fire(899_100_000)
    assert [r.paths for r in out] == [[f"p{i % 300}"] if i < 300 or i >= 600 else [] for i in range(900)]
    # More paths than a value holds are kept in the map; all goes when it is old.
    assert handle.held is not None and len(handle.far) == 300 - processor.NEAR and len(handle.timers) == 1
    fire(10**12)
    assert handle.held is None and not handle.timers and not handle.far


def test_texts_of_a_segment_are_tokenised_once(spark, tmp_path, monkeypatch):
    seen, plain = [], segments.tokens_of
    monkeypatch.setattr(segments, "tokens_of", lambda columns: seen.append(columns) or plain(columns))
    docs = spark.createDataFrame([(1, "red tea red"), (2, ""), (3, None), (4, "tea")], "id long, text string")
    assert segments.write(docs, docs.filter("id = 4").selectExpr("id", "'red cup' AS text"), str(tmp_path), 2, "id", ["text"]) == 4
    assert len(seen) == 2
    read = lambda name: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect()))
    assert [(t, k, tf, dl) for t, _, k, tf, dl, _ in read("postings")] == [("red", 1, 2, 3), ("tea", 1, 1, 3), ("tea", 4, 1, 1)]
    assert read("terms") == [("", 3, 2), ("cup", -1, 0), ("red", 0, 0), ("tea", 2, 0)]
    assert read("gone") == [(4, 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["blocks", "gone", "postings", "terms"]


def test_callers_that_cannot_be_among_the_first_are_left_out_early(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 40)
    members = spark.createDataFrame([(f"n{i}", [None, 1, 2, 3][i % 4]) for i in range(40)], "node string, g int")
    edges = spark.range(4000).selectExpr("IF(id % 97 = 0, NULL, concat('n', id * 7 % 43)) AS a", "concat('n', id * id % 41) AS b").coalesce(2)
    rows = graph.external_callers(edges, members, "a", "b", "node", "g").collect()
    want = []
    for g in (None, 1, 2, 3):
        own = sorted(((r.a is not None, r.a or "", r.b) for r in rows if r.grp == g))[:5]
        want += [(g, b, a if known else None, i + 1) for i, (known, a, b) in enumerate(own)]
    got = graph.external_callers(edges, members, "a", "b", "node", "g", 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    pairs = edges.join(members, edges.b == members.node).select("g", "a", "b")
    assert graph.first_of_groups(pairs, "g", ["a", "b"], 5).count() <= 2 * 4 * 5 * 2


def test_incremental_edges_move_calls_as_few_bytes(spark):
    """Shuffled and written: calls travel within their functions, not as rows that
    meet every rule, and candidates do not travel at all."""
    data, status = "/root/testdata/sf0.01", spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size())}

    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        catalog.QUERIES["incremental_edges"](spark, data).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    size = sum(n for stage, n in moved().items() if stage not in before)
    assert 50 * lines < size < 260 * lines, size / lines
