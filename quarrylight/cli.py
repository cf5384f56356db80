"""Command line: python -m quarrylight.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import stat
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylight import mcp
from quarrylight.api import TOOLS, CodeIndex
from quarrylight.operators import batches, rollup, summaries
from quarrylight.plans import context, index
from quarrylight.sources import llm_client
from quarrylight.store import IndexStore
from quarrylight.streaming import daemon, watch

FOLDER = ".quarrylight"
HOOK = "#!/bin/sh\n# quarrylight\npython -m quarrylight.cli {} --repo-root \"$(git rev-parse --show-toplevel)\"\n"
PROMPT = "Summarise each file and its functions as a JSON list of objects with path, purpose, summary, danger and functions (id, summary, summary_long, danger)."


def session() -> SparkSession:
    return SparkSession.builder.appName("quarrylight").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def selection(store: IndexStore, force: bool = False, paths: list[str] | None = None):
    """What needs a summary: one JSON payload a file, in greedy batches; with
    ``paths`` of these files alone."""
    files, functions = store.read("files"), store.read("functions")
    tainted = functions.filter("is_tainted").select(F.col("file").alias("path"))
    if paths is not None:
        files = files.join(files.sparkSession.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
    need = summaries.needing_summary(files, tainted, "path", force)
    members = functions.select(F.col("file").alias("path"), "id", "signature", "summary", "taint_source")
    rows = summaries.with_members(need.select("path", "purpose", "summary", "purpose_needs_update"), members, "path", ["id", "signature", "summary", "taint_source"])
    rows = rows.select("path", "purpose_needs_update", F.size("members").alias("n_functions"), F.to_json(F.struct("path", "purpose", "summary", "purpose_needs_update", "members")).alias("payload"), F.lit(0).alias("run"))
    return rows, lambda size: batches.greedy_batches(rows, "run", "path", F.floor(F.char_length("payload") / 4), size)


def summarise(spark, store: IndexStore, size: int, force: bool, dry: bool, paths: list[str] | None = None, name: str = "default") -> str:
    rows, packed = selection(store, force, paths)
    plan = packed(size).persist()
    try:
        if dry:
            cost = batches.cost_estimate(plan, "run", len(PROMPT)).collect()
            if not cost:
                return "Nothing to summarise."
            n = rows.agg(F.count_if("purpose_needs_update").alias("stale"), F.count_if(~F.col("purpose_needs_update")).alias("taint"), F.sum("n_functions").alias("functions")).first()
            lines = [f"{n.stale + n.taint} files ({n.stale} stale, {n.taint} for taint alone), {n.functions} functions"]
            return "\n".join(lines + [f"{r['n_batches']} batches, about {r['tokens_in']} tokens in, {r['tokens_out']} out" for r in cost])
        answers = llm_client.answers(plan.join(rows.select("path", "payload"), "path"), llm_client.summarizer(name), PROMPT, "batch", "payload").persist()
        with store.lock:
            errors = CodeIndex(spark, store).apply_answers(answers.filter("error IS NULL"))
        failed = [r["error"] for r in answers.filter("error IS NOT NULL").collect()] + [r["error"] for r in errors.collect()]
        done = plan.count()
        answers.unpersist()
        return f"{done} files summarised" + "".join(f"\nerror: {e}" for e in failed)
    finally:
        plan.unpersist()


def open_work(store: IndexStore):
    """How much of the index is stale or tainted: one row."""
    files = rollup.condition_counts(store.read("files"), stale_files=F.col("is_stale"), files=F.lit(True))
    functions = rollup.condition_counts(store.read("functions"), stale_functions=F.col("is_stale"), tainted=F.col("is_tainted"))
    return files.join(functions, F.lit(True))


def sync(spark, root: str, store: IndexStore, dry: bool, name: str = "default") -> str:
    """Indexes again and, unless ``dry``, summarises what has changed (all that
    is open, if nothing has)."""
    before = open_work(store).first()
    report = index.run(spark, root, store, full=True)
    after = open_work(store).first()
    more = {c: max(0, after[c] - before[c]) for c in ("stale_files", "stale_functions", "tainted")}
    lines = ["1. index", f"   {more['stale_files']} files changed, {more['stale_functions']} functions stale, {more['tainted']} tainted" if any(more.values()) else "   no files changed", f"   {after['files'] - more['stale_files']} files unchanged"]
    if report.failed:
        lines.append(f"   {report.failed} files with errors")
        lines += [f"   - {path}" for path, _ in report.errors]
    lines.append("2. summaries" + (" (dry run)" if dry else ""))
    lines += ["   " + x for x in summarise(spark, store, batches.MAX_ITEMS, False, dry, report.touched or None, name).split("\n")]
    if not dry:
        left = open_work(store).first()
        lines.append(f"   left: {left['stale_files']} files and {left['stale_functions']} functions stale, {store.read('taint_queue').count()} queued")
    return "\n".join(lines)


def install_hooks(root: str) -> str:
    """Git hooks for validation and the change log; others' hooks are kept aside."""
    folder = os.path.join(root, ".git", "hooks")
    os.makedirs(folder, exist_ok=True)
    for hook, command in (("pre-commit", "validate"), ("post-commit", "log-commit")):
        path = os.path.join(folder, hook)
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                if "quarrylight" not in f.read():
                    os.replace(path, path + ".bak")
        with open(path, "w", encoding="utf-8") as f:
            f.write(HOOK.format(command))
        os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return f"Hooks installed in {folder}."


def tool_config(root: str) -> str:
    """Adds the tool server to .mcp.json, which stays out of git as does the
    index, and writes a prompt that explains the tools."""
    path = os.path.join(root, ".mcp.json")
    own = {"command": sys.executable, "args": ["-m", "quarrylight.cli", "serve", "--repo-root", root]}
    try:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if not isinstance(config, dict) or not isinstance(config.get("mcpServers", {}), dict):
            raise ValueError("not an object of servers")
    except FileNotFoundError:
        config = {}
    except ValueError as problem:
        example = json.dumps({"mcpServers": {"quarrylight": own}}, indent=2)
        return f"Error: {path} is no valid configuration ({problem}). It should look like\n{example}\nMend or remove it and try again."
    servers = config.setdefault("mcpServers", {})
    said = "Already configured" if servers.get("quarrylight") == own else "Wrote"
    servers["quarrylight"] = own
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2)
    ignore = os.path.join(root, ".gitignore")
    have = ""
    if os.path.exists(ignore):
        with open(ignore, encoding="utf-8") as f:
            have = f.read()
    missing = [x for x in (FOLDER + "/", ".mcp.json") if x not in have.split("\n")]
    if missing:
        with open(ignore, "a", encoding="utf-8") as f:
            f.write(("" if have.endswith("\n") or not have else "\n") + "\n".join(missing) + "\n")
    prompt = os.path.join(root, FOLDER, "prompt.md")
    os.makedirs(os.path.dirname(prompt), exist_ok=True)
    with open(prompt, "w", encoding="utf-8") as f:
        f.write("# Tools of the code index\n\nAsk for a file's context before changing it; record dangers, decisions and changes afterwards.\n\n" + "\n".join(f"- `{n}`: {TOOLS[n][0]}" for n in TOOLS) + "\n")
    return f"{said}: {path}\nPrompt: {prompt}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrylight")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, **arguments):
        c = sub.add_parser(name)
        c.add_argument("--repo-root", default=".")
        for flag, options in arguments.items():
            c.add_argument(flag.replace("__", "--").replace("_", "-") if flag.startswith("__") else flag, **options)
        return c

    flag = {"action": "store_true"}
    command("init")
    command("status")
    command("summarize", **{"__batch_size": {"type": int, "default": batches.MAX_ITEMS}, "__force": flag, "__dry_run": flag})
    command("update", path={})
    command("validate", **{"__files": {"nargs": "*"}})
    command("log-commit", **{"__hash": {"default": "HEAD"}})
    command("install-hooks")
    command("sync", **{"__dry_run": flag})
    command("serve")
    command("generate-mcp-config")
    command("watch", action={"choices": ["start", "once", "stop", "status"]}, **{"__debounce_ms": {"type": int, "default": 500}, "__summarize": flag})
    a = p.parse_args(argv)
    root = os.path.abspath(a.repo_root)
    if a.command == "install-hooks":
        print(install_hooks(root))
        return 0
    if a.command == "generate-mcp-config":
        print(tool_config(root))
        return 0
    folder = os.path.join(root, FOLDER)
    if a.command == "watch" and a.action == "stop":
        print(daemon.stop(folder))
        return 0
    spark = session()
    store = IndexStore(spark, os.path.join(folder, "index"))
    if a.command == "init":
        report = index.run(spark, root, store, full=False)
        for k, v in vars(report).items():
            if not isinstance(v, list):
                print(f"{k:<12}{v:>8}")
        for path, error in report.errors:
            print(f"error: {path}: {error}")
        if report.failed > len(report.errors):
            print(f"error: {report.failed - len(report.errors)} files more")
    elif a.command == "sync":
        print(sync(spark, root, store, a.dry_run))
    elif a.command == "status":
        print(context.status_text(context.status(store)))
    elif a.command == "summarize":
        print(summarise(spark, store, a.batch_size, a.force, a.dry_run))
    elif a.command == "update":
        own = F.col("file") == a.path
        before = {r["id"]: r["summary"] for r in store.read("functions").filter(own).collect()}
        print(summarise(spark, store, batches.MAX_ITEMS, True, False, [a.path]))
        for r in store.read("functions").filter(own).orderBy("id").collect():
            print(f"{r['id']}: " + ("(unchanged)" if before.get(r["id"]) == r["summary"] else f"{before.get(r['id']) or '(none)'} -> {r['summary']}"))
    elif a.command == "validate":
        rows = index.validate(spark, root, store, a.files).collect()
        for r in rows:
            print(f"{r['status']:<12}{r['path']}")
        return int(any(r["status"] in ("stale", "not_indexed") for r in rows))
    elif a.command == "log-commit":
        print(f"{index.log_commit(spark, root, store, a.hash)} changes logged")
    elif a.command == "serve":
        mcp.serve(CodeIndex(spark, store, root), sys.stdin, sys.stdout)
    elif a.command == "watch":
        events = os.path.join(folder, "events")
        os.makedirs(events, exist_ok=True)
        if a.action == "start":
            watch.watch(spark, root, store, folder, a.debounce_ms / 1000, llm_client.summarizer() if a.summarize else None)
        elif a.action == "once":
            watch.Watcher(spark, root, store, events, os.path.join(folder, "checkpoint"), folder).start(True).awaitTermination()
        figures = context.status(store)
        print(json.dumps({**daemon.status(folder), "files": figures["files"], "stat_coverage": figures["coverage"]}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
