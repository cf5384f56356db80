"""Scans, batches, closures, intervals, trigrams, row deltas, segments and
incremental resolution against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import batches, graph, incremental, intervals, rowdeltas, search, trigrams
from quarrylight.operators.scan import running_sums
from quarrylight.scratch import settle
from quarrylight.store import Conflict, IndexStore


def test_running_sums_of_a_key_in_many_tasks(spark):
    rng = random.Random(1)
    rows = [(k, "x", t, rng.randrange(0, 9)) for k, n in (("a", 3000), (None, 2500), ("b", 1), ("c", 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, part string, t int, v long").repartition(7)
    got = {(r.k, r.t): r.v for r in running_sums(df, ["k", "part"], [F.asc("t")], ["v"]).collect()}
    total, want = {}, {}
    for k, _, t, v in rows:
        total[k] = total.get(k, 0) + v
        want[k, t] = total[k]
    assert got == want
    wrapped = {(r.k, r.t): r.v for r in running_sums(df, ["k", "part"], [F.asc("t")], ["v"], 7).collect()}
    assert wrapped == {k: v & 7 for k, v in want.items()}
    assert running_sums(df.filter("false"), ["k"], [F.asc("t")], ["v"]).count() == 0


@pytest.mark.parametrize(("items", "tokens", "chunk"), [(5, 30, 8), (3, 100, 3), (20, 40, 64), (1, 5, 4)])
def test_batches_of_long_groups(spark, items, tokens, chunk):
    rng = random.Random(items)
    rows = [(g, i, rng.choice([None, 0, 1, 7, 12, 29, 300])) for g, n in (("a", 500), ("b", 1), (None, 70), ("c", 8), ("d", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, t long").repartition(5)
    got = {(r.g, r.i): (r.tokens, r.batch) for r in batches.greedy_batches(df, "g", "i", F.col("t"), items, tokens, chunk).collect()}
    want, last, state = {}, object(), None
    for g, i, t in rows:
        if g != last:
            last, state = g, [0, 0, 0]
        if state[1] >= items or (state[1] and state[2] + (t or 0) > tokens):
            state = [state[0] + 1, 0, 0]
        state = [state[0], state[1] + 1, state[2] + (t or 0)]
        want[g, i] = (t, state[0])
    assert got == want


def test_closure_of_chains_and_loops(spark, monkeypatch):
    steps = [(i, i + 1) for i in range(400)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5), (7, None), (3, 50), (1001, 0)]
    df = spark.createDataFrame(steps, "c long, p long")
    rounds = []
    monkeypatch.setattr(graph, "settle", lambda df, name: rounds.append(name) or settle(df, name))
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestor_closure(df, "c", "p").collect()}
    ups = {}
    for a, b in steps:
        if b is not None and a != b:
            ups.setdefault(a, []).append(b)
    want = {}
    for start in ups:
        seen, now, d = {start}, [start], 0
        while now:
            d, now = d + 1, [b for a in now for b in ups.get(a, [])]
            now = [b for b in dict.fromkeys(now) if b not in seen]
            seen |= set(now)
            want |= {(start, b): d for b in now}
    assert got == want and len(rounds) <= 11
    cut = {(r.node, r.ancestor): r.distance for r in graph.ancestor_closure(df, "c", "p", 5).collect()}
    assert cut == {k: d for k, d in want.items() if d <= 5}


def test_many_seeds(spark):
    rng = random.Random(11)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "node string")
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)], "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n7",), ("n8",), ("n7",), ("zz",)], "s string")
    base, parts = graph.seeded_centralities(nodes, edges, seeds)
    plan = parts._jdf.queryExecution().toString()
    shared = {r.node: r.score for r in base.collect()}
    extra = {(r.seed, r.node): r.score for r in parts.collect()}
    for seed in ("n1", "n7", "n8", "zz"):
        want = {r.node: r.score for r in graph.seeded_centrality(nodes, edges, seed).collect()}
        own = None if seed == "zz" else seed
        assert {n: s + extra.get((own, n), 0.0) for n, s in shared.items()} == pytest.approx(want)
        if own:
            best = sorted(want, key=lambda n: (-round(want[n], 9), n))[:4]
            got = graph.best_of_seeds(base, parts, seeds.filter("s <> 'zz'"), 4).filter(F.col("seed") == seed).orderBy("rank").collect()
            assert [r.node for r in got] == best
    assert "ReusedExchange" in plan or "AdaptiveSparkPlan" in plan


@pytest.mark.parametrize("hot", [100_000, 5])
def test_points_in_intervals(spark, hot):
    rng = random.Random(2)
    spans = [(i, s, s + rng.choice([-1, 0, 1, 3, 16, 17, 500, 100_000])) for i in range(120) for s in [rng.randrange(-500, 2000)]] + [(900, None, 5), (901, 5, None)]
    points = [(i, rng.choice([100, 101, rng.randrange(-600, 2600)])) for i in range(300)] + [(999, None)]
    a, b = spark.createDataFrame(points, "pid int, at long"), spark.createDataFrame(spans, "iid int, s long, e long")
    out = intervals.contained(a, b, "at", "s", "e", hot)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((p, i) for p, at in points for i, s, e in spans if None not in (at, s, e) and s <= at <= e)
    assert sorted((r.pid, r.iid) for r in out.collect()) == want
    assert intervals.contained(a, b.filter("false"), "at", "s", "e").count() == 0


def test_trigrams(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB é%_") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "", "ab", "Straße É", "x" * 5000 + "needle" + "y" * 5000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "id int, text string, block string").repartition(3)
    index = trigrams.TrigramIndex(df, "id", ["text"])
    for pattern in ("aba", "AbA b", "é", "é%", "", "a_b", "NEEDLE", "zzz", "ße É"):
        want = sorted(i for i, t in enumerate(texts) if t is not None and pattern.lower() in t.lower())
        assert sorted(r.id for r in index.search(pattern).collect()) == want, pattern
    assert index.candidates("needle").count() == 1


TABLES, KEYS = {"t": "a string, b int, v string"}, {"t": ["a", "b"]}


def test_row_deltas(spark, tmp_path):
    store, want = IndexStore(spark, str(tmp_path), TABLES, KEYS, None, grace=0), {}
    frame = lambda rows: spark.createDataFrame(rows, TABLES["t"])
    rng = random.Random(4)
    state = lambda: {(r.a, r.b): r.v for r in store.read("t").collect()}
    assert state() == {}
    for n in range(12):
        rows = {(rng.choice("abc"), rng.randrange(8)): f"v{n}.{i}" for i in range(5)}
        gone = {(rng.choice("abc"), rng.randrange(8)) for _ in range(3)} - set(rows)
        store.commit(rows={"t": frame([(*k, v) for k, v in rows.items()])}, gone={"t": frame([(*k, None) for k in gone])})
        want = {k: v for k, v in want.items() if k not in gone} | rows
        assert state() == want
        if n == 7:
            store.compact()
            assert state() == want and store.state()["tables"]["t"]["deltas"] == []
    one = store.read("t").filter("a = 'a' AND b = 3")
    assert "PushedFilters: [IsNotNull(a), IsNotNull(b), EqualTo(a,a), EqualTo(b,3)]" in one._jdf.queryExecution().toString()
    store.commit({"t": frame([("z", 1, "only")])})
    assert state() == {("z", 1): "only"}


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (IndexStore(spark, str(tmp_path), TABLES, KEYS, None) for _ in range(2))
    frame = lambda *rows: spark.createDataFrame(rows, TABLES["t"])
    a.commit({"t": frame(("x", 1, "first"))})
    publish = a.publish

    def late(state):  # another process commits first
        monkeypatch.setattr(a, "publish", publish)
        b.commit(rows={"t": frame(("y", 1, "other"))})
        return publish(state)

    monkeypatch.setattr(a, "publish", late)
    a.commit(rows={"t": frame(("x", 1, "second"))})
    assert sorted(map(tuple, a.read("t").collect())) == [("x", 1, "second"), ("y", 1, "other")]
    monkeypatch.setattr(a, "publish", late)
    with pytest.raises(Conflict):
        a.commit({"t": frame(("q", 1, "whole"))})
    assert a.read("t").count() == 2


def test_folding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarrylight.store.MOST_DELTAS", 3)
    store = IndexStore(spark, str(tmp_path), TABLES, KEYS, None, grace=0)
    for n in range(6):
        store.commit(rows={"t": spark.createDataFrame([("k", n % 2, f"v{n}")], TABLES["t"])})
        assert len(store.state()["tables"]["t"]["deltas"]) <= 3
    assert sorted(map(tuple, store.read("t").collect())) == [("k", 0, "v4"), ("k", 1, "v5")]
    assert len(list((tmp_path / "t").iterdir())) <= 6


def test_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarrylight.operators.segments.MOST", 2)
    monkeypatch.setattr("quarrylight.operators.segments.BLOCK_BITS", 1)
    monkeypatch.setattr("quarrylight.operators.segments.FIRST", 2)
    schema = "id long, text string"
    store = IndexStore(spark, str(tmp_path), {"t": schema}, {"t": ["id"]}, ("t", "id", ["text"]))
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["red", "green", "blue", "Red", "tea", "cup"]) for _ in range(rng.randrange(0, 25)))
    now = {i: text() for i in range(60)}
    store.commit({"t": spark.createDataFrame(list(now.items()), schema)})
    pruned = False
    for step in range(3):
        rows = {rng.randrange(90): text() for _ in range(7)} | {200 + step: None}
        gone = {i for i in rng.sample(sorted(now), 4)} - set(rows)
        store.commit(rows={"t": spark.createDataFrame(list(rows.items()), schema)}, gone={"t": spark.createDataFrame([(i, None) for i in gone], schema)})
        now = {k: v for k, v in now.items() if k not in gone} | rows
        docs, index = spark.createDataFrame(list(now.items()), schema), store.index()
        assert len(index.parts) <= 3
        for query in ("red tea", "nothing red", "") if step < 2 else ("blue green red", "cup"):
            want = [tuple(r) for r in search.bm25(docs, query, "id", ["text"], limit=None).collect()]
            assert step or [tuple(r) for r in index.search(query, None).collect()] == want
            assert [tuple(r) for r in index.search(query, 5).collect()] == want[:5]
            pruned |= index.read_blocks < index.matching
    assert pruned
    store.compact()
    assert len(store.index().parts) == 1
    assert [tuple(r) for r in store.index().search("red tea", None).collect()] == [tuple(r) for r in search.bm25(docs, "red tea", "id", ["text"], limit=None).collect()]


def state_of(spark, files):
    """files: name -> (imports: [(module, target)], supers, {function: (class, calls)})."""
    f, i, e, x, s = [], [], [], [], []
    for path, (imports, supers, functions) in files.items():
        for name, (cls, calls) in functions.items():
            f.append((f"{path}::{cls + '.' if cls else ''}{name}", path, cls, name, calls))
            if not cls:
                x.append((path, name))
        i += [(path, m, [], None) for m, _ in imports]
        e += [(path, t) for _, t in imports if t in files]
        s += [(path, *pair) for pair in supers]
    return incremental.CodeState(
        spark.createDataFrame(f, "id string, file string, class_name string, name string, calls array<struct<name:string,object:string>>"),
        spark.createDataFrame(i, "path string, module string, names array<string>, alias string"),
        spark.createDataFrame(e, "src string, dst string").distinct(),
        spark.createDataFrame(x, "file string, name string"),
        spark.createDataFrame(s, "file string, class_name string, super string"),
    )


def random_files(rng, n):
    names, classes = ["run", "get", "area", "only", "twice"], [None, None, "A", "B"]
    out = {}
    for k in range(n):
        functions = {name: (rng.choice(classes), [(rng.choice([*names, "none"]), rng.choice([None, "self", "mod", "A", "thing"])) for _ in range(3)]) for name in rng.sample(names, 2)}
        out[f"f{k}"] = ([("mod", f"f{rng.randrange(n + 3)}") for _ in range(rng.randrange(0, 3))], [("A", "B")] if rng.random() < 0.3 else [], functions)
    return out


def test_incremental_edges(spark):
    rng = random.Random(6)
    files = random_files(rng, 14)
    old = state_of(spark, files)
    before = settle(old.resolve(), "edges")
    for _ in range(2):
        after, other = dict(files), random_files(rng, 17)
        changed = rng.sample(sorted(after), 2) + ["f15"]
        after[changed[0]] = other[changed[0]]
        del after[changed[1]]
        after["f15"] = other["f15"]
        # Imports of unchanged files may lead to a new file, and no longer to a lost one.
        new = state_of(spark, after)
        sites = incremental.affected_sites(old, new, before, spark.createDataFrame([(c,) for c in changed], "file string"))
        rows, gone = incremental.edge_changes(old, new, before, spark.createDataFrame([(c,) for c in changed], "file string"), lambda df: settle(df, "edges"))
        keys = ["caller_id", "pos"]
        changes = rowdeltas.as_upserts(rows, before.columns, 1).unionByName(rowdeltas.as_tombstones(gone, keys, before.schema, 1))
        got = sorted(map(tuple, rowdeltas.merged(before, changes, keys).collect()), key=str)
        assert got == sorted(map(tuple, new.resolve().collect()), key=str)
        assert sites.count() < new.resolve().count()


def test_quiet_bursts(spark):
    import datetime as dt

    from quarrylight.streaming import processor

    rng = random.Random(7)
    begin, rows, at = dt.datetime(2024, 1, 1), [], 0
    for _ in range(400):
        at += rng.choice([1, 2, 20, 59, 60, 61, 300])
        rows.append((rng.choice(["a", "b", "c"]), begin + dt.timedelta(seconds=at), rng.choice(["x", "y"]), rng.choice(["1", "2", None])))
    df = spark.createDataFrame(rows, "root string, ts timestamp, path string, hash string")
    cut = [begin + dt.timedelta(seconds=at * k // 3) for k in (1, 2)]
    parts = [df.filter(F.col("ts") < cut[0]), df.filter((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), df.filter(F.col("ts") >= cut[1])]
    batch = sorted(map(tuple, processor.quiet_batch(df, "root", "ts", "path", "hash", 60).collect()))
    want = []
    for root in "abc":
        own, seen, bursts = sorted(r for r in ((int((t - begin).total_seconds()), p, h or "") for k, t, p, h in rows if k == root)), {}, []
        for t, p, h in own:
            if not bursts or t - bursts[-1][-1][0] > 60:
                bursts.append([])
            bursts[-1].append((t, p, h))
        for b in bursts:
            last = {p: (t, h) for t, p, h in b}
            changed = sorted(p for p, (_, h) in last.items() if seen.get(p) != h)
            seen |= {p: h for p, (_, h) in last.items()}
            want.append((root, b[0][0], len(b), changed))
    zero = int((begin - dt.datetime(1970, 1, 1)).total_seconds())
    assert batch == sorted((k, (t + zero) * 10**6, n, c) for k, t, n, c in want)
    assert sorted(map(tuple, processor.run_to_end(spark, parts, "root", "ts", "path", "hash", 60).collect())) == batch


def test_bursts_take_late_events():
    from quarrylight.streaming.processor import absorbed

    bursts = []
    for at, path in ((100, "a"), (300, "b"), (200, "c"), (900, "d"), (850, "a")):
        bursts = absorbed(bursts, at, path, None, 100)
    assert [(b["first"], b["last"], b["n"], sorted(b["paths"])) for b in bursts] == [(100, 300, 3, ["a", "b", "c"]), (850, 900, 2, ["a", "d"])]
