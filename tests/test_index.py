import io
import json
import logging
import os
import subprocess
import sys
import threading

import pytest

from quarrylight import cli, mcp
from quarrylight.api import CodeIndex
from quarrylight.plans import context, index
from quarrylight.sources import files as sources
from quarrylight.store import IndexStore
from quarrylight.streaming import daemon
from quarrylight.streaming.producer import Producer
from quarrylight.streaming.watch import SummaryQueue, Watcher, summarise_functions


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("work repo")
    (root / "app").mkdir()
    (root / "app" / "core.py").write_text("def base(x):\n    return x\n\ndef helper(x):\n    return base(x)\n")
    (root / "app" / "main.py").write_text("from app import core\nfrom app.core import helper\n\nclass Runner:\n    def go(self):\n        self.n = core.helper(1)\n        return self.stop()\n    def stop(self):\n        return None\n")
    (root / "web.ts").write_text('import { x } from "./lib";\nexport function page() { return x(); }\n')
    (root / "lib.ts").write_text("export function x() { return 1; }\n")
    (root / "notes.txt").write_text("text\n")
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "first")
    return root


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return IndexStore(spark, str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def first(spark, repo, store):
    return index.run(spark, str(repo), store)


def test_first_run(first, store):
    assert (first.tracked, first.parsed, first.functions, first.new, first.tainted) == (5, 4, 6, 6, 0) and not first.errors
    files = {r.path: r for r in store.read("files").collect()}
    assert files["app/main.py"].imports == ["app/core.py"] and files["app/core.py"].used_by == ["app/main.py"]
    assert files["web.ts"].imports == ["lib.ts"] and files["lib.ts"].is_stale
    edges = {(r.caller_id, r.callee_name): r.callee_id for r in store.read("call_graph").collect()}
    assert edges["app/main.py::Runner.go", "helper"] == "app/core.py::helper"
    assert edges["app/main.py::Runner.go", "stop"] == "app/main.py::Runner.stop"
    assert {r.path: r.file_count for r in store.read("directories").collect()} == {".": 5, "app": 2}


def test_incremental_runs(spark, first, repo, store):
    again = index.run(spark, str(repo), store, full=False)
    assert (again.parsed, again.reused, again.changed) == (0, 4, 0)
    path = repo / "app" / "core.py"
    path.write_text(path.read_text() + "\n# a remark\n")
    assert index.run(spark, str(repo), store, full=False).changed == 0
    path.write_text("def base(x):\n    return x + 1\n\ndef helper(x):\n    return base(x)\n")
    dry = index.run(spark, str(repo), store, full=False, dry_run=True)
    real = index.run(spark, str(repo), store, full=False)
    assert dry.changed == real.changed == 1 and real.parsed == 1
    rows = {r.id: r for r in store.read("functions").collect()}
    assert rows["app/core.py::helper"].is_tainted and rows["app/core.py::helper"].taint_source == "app/core.py::base"
    assert rows["app/core.py::base"].confidence == pytest.approx(0.85) and not rows["app/main.py::Runner.go"].is_tainted
    assert [r.function_id for r in store.read("taint_queue").collect()] == ["app/core.py::helper"]
    full = index.run(spark, str(repo), store)
    assert full.changed == 0 and full.functions == 6


def test_tools(spark, first, repo, store):
    tools = CodeIndex(spark, store, str(repo))
    assert tools.get_context() == "Error: 'file' argument is required."
    assert "helper" in tools.get_context("app/main.py", 6) and "not indexed" in tools.get_context("zz.py")
    assert "Runner" in tools.get_callers("app/core.py::helper")
    assert tools.add_danger("never retry").startswith("Danger added") and tools.add_danger("never retry").startswith("Danger already")
    assert "[*] never retry" in tools.get_context("app/main.py")
    danger = tools.store.read("dangers").first().id
    assert tools.remove_danger(danger) == f"Danger removed: {danger}" and tools.get_dangers() == "No dangers."
    tools.add_decision("use parquet", "columns", alternatives="csv")
    assert "instead of csv" in tools.get_decisions()
    assert "Updated" in tools.update_file("app/core.py", purpose="numbers and sums") and "Updated" in tools.update_summary(type="function", id="app/core.py::base", summary="adds one")
    assert tools.search("sums").startswith("1. app/core.py") and "base" in tools.search("adds one")
    assert "def base(x):" in tools.get_function("app/core.py::base") and "adds one" in tools.get_function("app/core.py::base")
    tools.mark_tainted("app/core.py::base", "why")
    assert "app/core.py::base" in tools.get_tainted() and "cleared" in tools.clear_taint("app/core.py::base") and "Error" in tools.clear_taint("app/core.py::base")
    for i in range(12):
        tools.log_session(f"s{i}", ["a", "b"])
    assert store.read("session_log").count() == 10
    tools.log_change("x.py", "one")
    tools.log_change("y.py", "two")
    assert store.read("changes").count() == 2
    tools.plan("next")
    assert "PLAN: next" in [r.entry for r in store.read("session_log").collect()]
    assert tools.mark_tainted("app/core.py::base") == "Error: 'taint_source' argument is required."
    assert "functions" in tools.ctx_status() and tools.call("nope").startswith("Error") and tools.call("get_function", bad=1).startswith("Error")
    answer = json.dumps([{"path": "lib.ts", "purpose": "tiny", "functions": [{"id": "lib.ts::x", "summary": "one"}]}])
    assert tools.apply_answers(spark.createDataFrame([(answer,), ("",)], "answer string")).count() == 1
    assert tools.row("files", path="lib.ts").purpose == "tiny" and tools.row("functions", id="lib.ts::x").summary == "one"
    assert len(context.assemble(store, "app/main.py", budget=1)) < len(context.assemble(store, "app/main.py"))


def test_commits_and_validation(spark, first, repo, store):
    assert index.log_commit(spark, str(repo), store) == 5 and index.log_commit(spark, str(repo), store) == 0
    (repo / "lib.ts").write_text("export function x() { return 2; }\n")
    (repo / "new.go").write_text("package a\nfunc F() {}\n")
    git(repo, "add", "lib.ts", "new.go", "notes.txt")
    got = {r.path: r.status for r in index.validate(spark, str(repo), store).collect()}
    assert got == {"lib.ts": "stale", "new.go": "not_indexed"}
    with pytest.raises(ValueError):
        sources.assert_work_tree("/")


def test_watcher(spark, first, repo, store, tmp_path):
    index.run(spark, str(repo), store)
    events = tmp_path / "events"
    events.mkdir()
    (repo / "lib.ts").write_text("export function x() { return 3; }\n")
    (repo / "web.ts").unlink()
    rows = [{"ts": "2024-01-01T00:00:00Z", "path": p, "kind": "modified", "is_directory": False} for p in ("lib.ts", "lib.ts", "web.ts", "notes.txt", "app/core.py")]
    (events / "1.json").write_text("\n".join(map(json.dumps, rows)))
    done = []
    w = Watcher(spark, str(repo), store, str(events), str(tmp_path / "checkpoint"), str(tmp_path / "state"), SummaryQueue(lambda ids: done.extend(ids) or len(ids)))
    w.start(once=True).awaitTermination()
    assert w.query.exception() is None
    assert (w.counts["events"], w.counts["deleted"], w.counts["reindex"], w.counts["unchanged"]) == (5, 1, 1, 1)
    again = Watcher(spark, str(repo), store, str(events), str(tmp_path / "checkpoint"), w.folder)
    assert again.counts == w.counts and daemon.load(w.folder)["reindex"] == 1
    files = {r.path: r for r in store.read("files").collect()}
    assert files["web.ts"].is_stale and files["lib.ts"].semantic_hash
    w.stop()
    assert done == ["lib.ts::x"]


def test_summaries_of_what_was_indexed_again(spark, first, repo, store):
    (repo / "lib.ts").write_text("export function x() { return 3; }\n")
    index.run(spark, str(repo), store, full=False)

    def fn(prompt):
        f = json.loads(prompt[prompt.index("\n[") + 1 :])[0]
        assert f["source"] == "export function x() { return 3; }" or f["id"] != "lib.ts::x"
        return json.dumps([{"path": f["path"], "purpose_needs_update": False, "functions": [{"id": f["id"], "summary": "three"}]}])

    assert summarise_functions(spark, store, str(repo), ["lib.ts::x", "gone.py::f"], fn) == 1
    row = CodeIndex(spark, store, str(repo)).row("functions", id="lib.ts::x")
    assert (row.summary, row.confidence, row.is_stale) == ("three", 0.8, False)


def test_producer_waits_for_quiet(repo, tmp_path):
    now = [0.0]
    p = Producer(str(repo), str(tmp_path), 0.5, lambda: now[0])
    assert p.look() == 0
    (repo / "app" / "late.py").write_text("x = 1\n")
    (repo / "more.txt").write_text("not of a known language")
    assert p.look() == 0
    now[0] = 0.4
    (repo / "app" / "late.py").write_text("x = 12\n")
    assert p.look() == 0
    now[0] = 0.8  # the second change has started the time again
    assert p.look() == 0
    now[0] = 1.0
    assert p.look() == 1 and p.look() == 0
    (repo / "app" / "late.py").unlink()
    p.look()
    now[0] = 2.0
    assert p.look() == 1
    rows = [json.loads(x) for f in sorted(tmp_path.glob("*.json"), key=lambda f: f.stat().st_mtime_ns) for x in f.read_text().splitlines()]
    assert [(r["path"], r["kind"]) for r in rows] == [("app/late.py", "modified"), ("app/late.py", "deleted")]
    (repo / "more.txt").unlink()


def test_daemon_files(tmp_path):
    folder = str(tmp_path)
    assert daemon.stop(folder) == "The watcher is not running." and daemon.status(folder) == {"running": False, "pid": None}
    daemon.begin(folder)
    daemon.save(folder, {"events": 3})
    assert daemon.status(folder) == {"running": True, "pid": os.getpid(), "events": 3}
    sleeper = subprocess.Popen([sys.executable, "-c", "import time; time.sleep(60)"])
    daemon.write(folder, daemon.PID, str(sleeper.pid))
    with pytest.raises(RuntimeError):
        daemon.begin(folder)
    threading.Thread(target=sleeper.wait, daemon=True).start()
    assert daemon.stop(folder) == "The watcher has ended." and daemon.status(folder)["running"] is False
    daemon.write(folder, daemon.PID, str(sleeper.pid))
    assert "already" in daemon.stop(folder) and daemon.read_pid(folder) is None
    daemon.write(folder, daemon.PID, "no number")
    assert daemon.read_pid(folder) is None


def test_a_hanging_watcher_is_killed(tmp_path):
    folder = str(tmp_path)
    deaf = subprocess.Popen([sys.executable, "-c", "import signal, time; signal.signal(signal.SIGTERM, signal.SIG_IGN); print('up', flush=True); time.sleep(60)"], stdout=subprocess.PIPE)
    assert deaf.stdout.readline() == b"up\n"
    daemon.write(folder, daemon.PID, str(deaf.pid))
    threading.Thread(target=deaf.wait, daemon=True).start()
    assert "killed" in daemon.stop(folder, 0.5) and daemon.read_pid(folder) is None


def test_the_log_is_kept_short(tmp_path, monkeypatch):
    monkeypatch.setattr(daemon, "LOG_BYTES", 1000)
    handler = daemon.log_to(str(tmp_path))
    try:
        for i in range(200):
            logging.getLogger("quarrylight.watch").info("flush: %s", i)
    finally:
        logging.getLogger("quarrylight").removeHandler(handler)
        handler.close()
    names = sorted(f.name for f in tmp_path.iterdir())
    assert names == ["watch.log", *(f"watch.log.{k}" for k in range(1, daemon.LOG_KEPT + 1))] and "flush: 199" in (tmp_path / "watch.log").read_text()


def test_mcp_messages(spark, first, repo, store):
    tools = CodeIndex(spark, store, str(repo))
    sent = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_callers", "arguments": {"function_id": "app/core.py::helper"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nope"}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "update_file", "arguments": {"wrong": 1}}},
        {"jsonrpc": "2.0", "id": 6, "method": "zz"},
        {"jsonrpc": "2.0", "id": 7, "method": "ping"},
        {"jsonrpc": "2.0", "id": 8, "method": "tools/call", "params": {}},
    ]
    out = io.StringIO()
    mcp.serve(tools, [*map(json.dumps, sent), "not json", "", "[]", "7"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {r["id"]: r for r in got if r["id"]}
    assert by[1]["result"]["capabilities"] == {"tools": {}} and by[7]["result"] == {}
    listed = {t["name"]: t["inputSchema"] for t in by[2]["result"]["tools"]}
    assert set(listed) == {*CodeIndex.READ, *CodeIndex.WRITE} and listed["mark_tainted"]["required"] == ["function_id", "taint_source"]
    assert "Runner" in by[3]["result"]["content"][0]["text"] and not by[3]["result"]["isError"]
    assert by[4]["result"]["isError"] and by[5]["result"]["isError"] and by[6]["error"]["code"] == -32601 and by[8]["error"]["code"] == -32602
    assert [r["error"]["code"] for r in got if not r["id"]] == [-32700, -32600]


def test_tool_config(tmp_path):
    root = str(tmp_path)
    (tmp_path / ".mcp.json").write_text("{ broken")
    assert cli.tool_config(root).startswith("Error") and (tmp_path / ".mcp.json").read_text() == "{ broken"
    (tmp_path / ".mcp.json").write_text('{"mcpServers": {"other": {"command": "x"}}}')
    assert cli.tool_config(root).startswith("Wrote") and cli.tool_config(root).startswith("Already configured")
    servers = json.loads((tmp_path / ".mcp.json").read_text())["mcpServers"]
    assert set(servers) == {"other", "quarrylight"} and (tmp_path / ".gitignore").read_text().split("\n")[:2] == [".quarrylight/", ".mcp.json"]
    assert "get_context" in (tmp_path / ".quarrylight" / "prompt.md").read_text()


def test_sync_reports(spark, first, repo, store):
    index.run(spark, str(repo), store)
    (repo / "app" / "core.py").write_text("def base(x):\n    return x + 5\n\ndef helper(x):\n    return base(x)\n")
    said = cli.sync(spark, str(repo), store, True)
    assert "2. summaries (dry run)" in said and "batches" in said and "1. index" in said


def test_store_takes_uris(spark, tmp_path):
    a, b = IndexStore(spark, str(tmp_path / "x y"), grace=0), IndexStore(spark, f"file://{tmp_path}/x y")
    row = spark.range(1).selectExpr("'p' AS path", "NULL AS system", "'s' AS summary", "1L AS file_count", "NULL AS updated_at")
    for k in range(5):
        a.commit({"directories": row.selectExpr("path", "CAST(system AS string) system", "summary", f"{k}L AS file_count", "CAST(updated_at AS timestamp) updated_at")})
    assert b.read("directories").first().file_count == 4 and len(list((tmp_path / "x y" / "directories").iterdir())) == 3
