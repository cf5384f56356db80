"""Context documents: ranked, budgeted text about a file, from bounded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions.scalar import LOW, STALE, ordered_union
from quarrylight.operators import batches, graph, retention, rollup
from quarrylight.store import IndexStore

RULE = "─" * 60
BUDGET = batches.BUDGET
CALLEES, CALLERS = 15, 8


def tag(row) -> str:
    if row["is_stale"]:
        return " [STALE]"
    if row["confidence"] is not None and row["confidence"] < STALE:
        return " [LIKELY STALE]"
    return " [LOW CONFIDENCE]" if row["confidence"] is not None and row["confidence"] < LOW else ""


def heading(row, short: bool = False) -> list[str]:
    """A file's header."""
    out = [f"## {row['path']}{tag(row)}"]
    if row["system"]:
        out.append(f"System: {row['system']}")
    if row["purpose"]:
        out.append(f"Purpose: {row['purpose']}")
    if row["danger"]:
        out.append(f"DANGER: {row['danger']}")
    if row["last_change"]:
        out.append(f"Last change: {row['last_change']}")
    if not short:
        if row["summary"]:
            out.append(f"Summary: {row['summary']}")
        if row["exports"]:
            out.append("Exports: " + ", ".join(row["exports"][:10]))
        if row["imports"]:
            out.append("Imports: " + ", ".join(row["imports"][:10]))
    return out


def function_lines(row, short: bool = False) -> list[str]:
    out = [f"- {row['signature']}  (lines {row['line_start']}-{row['line_end']}){tag(row)}"]
    text = row["summary"] if short or not row["summary_long"] else row["summary_long"]
    if text:
        out.append(f"  {text}")
    if row["mutates"]:
        out.append("  Mutates: " + ", ".join(row["mutates"]))
    if row["danger"]:
        out.append(f"  DANGER: {row['danger']}")
    return out


def guardrails(store: IndexStore, path: str, deps: list[str], compact: bool = False) -> str:
    """Zone 3: the project, the tree around the file, dangers, decisions and,
    unless compact, the last sessions."""
    files, dirs = store.read("files"), store.read("directories")
    systems = rollup.group_counts(files, "system").orderBy(F.desc("n"), "system").collect()
    out = ["# Project", ", ".join(f"{r['system']}: {r['n']} files" for r in systems) or f"{files.count()} files"]
    tree = rollup.folded_tree(files.select("path"), path, directories=dirs.select("path", "summary")).orderBy("kind", "entry").collect()
    out += [r["entry"] for r in tree]
    dangers = store.read("dangers").filter(F.col("scope").isNull() | F.col("scope").isin("*", path, *deps)).orderBy("scope", "id").collect()
    if dangers:
        out.append("# Dangers")
        out += [f"[{r['scope'] or '*'}] {r['description']}" + (f" ({r['reason']})" if r["reason"] and not compact else "") for r in dangers]
    decisions = store.read("decisions").filter(F.col("scope").isNull() | F.col("scope").isin("*", path)).orderBy("id").collect()
    if decisions:
        out.append("# Decisions")
        for r in decisions:
            out.append(f"[{r['scope'] or '*'}] {r['decision']}")
            if not compact:
                out += [f"  {k}: {r[c]}" for k, c in (("Alternatives", "alternatives"), ("Reason", "reason")) if r[c]]
    if not compact:
        sessions = retention.latest(store.read("session_log"), "timestamp", "id", 3).collect()
        if sessions:
            out.append("# Recent sessions")
            out += [f"{r['timestamp']}: {r['entry']}" + (f" [{r['files_touched']}]" if r["files_touched"] else "") for r in sessions]
    return "\n".join(out)


def focus(store: IndexStore, row, line: int | None, short: bool = False) -> str:
    """Zone 0: the file, its functions (paged), taint warnings, recent changes."""
    functions = store.read("functions").filter(F.col("file") == row["path"])
    page = batches.page_rows(functions, "file", "line_start", "line_end", line).orderBy("pos").collect()
    out = heading(row, short) + ["", "Functions:"]
    for r in page:
        out += function_lines(r, short)
    if page and page[0]["total"] > len(page):
        out.append(f"... {page[0]['total'] - len(page)} more of {page[0]['total']} functions")
    tainted = [r for r in page if r["is_tainted"]]
    if tainted:
        out.append("Taint warnings:")
        out += [f"- {r['name']}: depends on {r['taint_source'] or 'something'} that has changed" for r in tainted]
    changes = retention.latest(store.read("changes").filter(F.col("file") == row["path"]), "timestamp", "commit_hash", 3).collect()
    if changes:
        out.append("Recent changes:")
        out += [f"- {(r['commit_hash'] or '?')[:7]} {r['summary']} ({r['author']})" for r in changes]
    return "\n".join(out)


def interface(store: IndexStore, row, short: bool = False) -> str:
    """Zone 1: the best-ranked of what the file imports and is used by."""
    files = store.read("files")
    own = files.filter(F.col("path") == row["path"])
    around = own.select(F.posexplode(ordered_union(F.col("imports"), F.col("used_by"))).alias("pos", "node"))
    edges = files.select(F.col("path").alias("src"), F.explode("imports").alias("dst"))
    nodes = files.select(F.col("path").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    scores = graph.seeded_centrality(nodes, edges, row["path"])
    best = around.join(scores, "node", "left").orderBy(F.round("score", 9).desc_nulls_last(), "pos").limit(graph.TOP).withColumnRenamed("node", "path")
    rows = best.join(files, "path").orderBy(F.round("score", 9).desc_nulls_last(), "pos").collect()
    out = ["# Related files"]
    for r in rows:
        if (r["used_by_count"] or 0) > graph.COMPRESS:
            out += [f"## {r['path']}{tag(r)}", f"Used by {r['used_by_count']} files; {r['purpose'] or 'no purpose known'}"]
        else:
            out += heading(r, short)
    return "\n".join(out)


def call_zone(store: IndexStore, row) -> str:
    """Zone 2: what the file's functions call, and who calls them from outside."""
    f, e = store.read("functions").select("id", "file", "signature", "summary"), store.read("call_graph")
    mine = f.filter(F.col("file") == row["path"]).select(F.col("id").alias("caller_id"))
    targets = e.join(mine, "caller_id", "left_semi").filter("callee_id IS NOT NULL").select(F.col("callee_id").alias("id")).distinct().join(f, "id", "left").orderBy("id").limit(CALLEES).collect()
    inside = f.filter(F.col("file") == row["path"]).select(F.col("id").alias("callee_id"))
    outer = e.join(inside, "callee_id", "left_semi").join(mine, "caller_id", "left_anti").select(F.col("caller_id").alias("id")).distinct().join(f, "id", "left").orderBy("id").limit(CALLERS).collect()
    out = ["# Call graph"]
    for title, rows in (("Calls:", targets), ("Called by:", outer)):
        if rows:
            out.append(title)
            out += [f"- {r['id']}" + (f": {r['summary']}" if r["summary"] else "") for r in rows]
    return "\n".join(out)


def assemble(store: IndexStore, path: str, line: int | None = None, budget: int = BUDGET) -> str:
    """The document for a file, shortened step by step until it fits: short
    summaries, short neighbours, no call graph, compact guardrails."""
    row = store.read("files").filter(F.col("path") == path).first()
    if row is None:
        return f"File '{path}' is not indexed."
    deps = list(dict.fromkeys([*(row["imports"] or []), *(row["used_by"] or [])]))
    tokens = lambda zones: sum(map(len, zones)) // 4
    zones = [guardrails(store, path, deps), focus(store, row, line), interface(store, row), call_zone(store, row)]
    steps = [(1, lambda: focus(store, row, line, True)), (2, lambda: interface(store, row, True)), (3, lambda: ""), (0, lambda: guardrails(store, path, deps, True))]
    for at, shorter in steps:
        if tokens(zones) <= budget:
            break
        zones[at] = shorter()
    text = f"\n{RULE}\n".join(z for z in zones if z)
    return text if tokens(zones) <= budget else f"{text}\n{RULE}\nWarning: about {tokens(zones)} tokens, more than the budget of {budget}."


def status(store: IndexStore) -> dict:
    """All figures of the status report: one pass a table."""
    files, functions, edges = (store.read(t) for t in ("files", "functions", "call_graph"))
    f = rollup.condition_counts(files, files=F.lit(True), stale=F.col("is_stale"), without_purpose=F.col("purpose").isNull(), cached=F.col("mtime").isNotNull()).first().asDict()
    g = rollup.condition_counts(functions, functions=F.lit(True), stale_functions=F.col("is_stale"), tainted=F.col("is_tainted"), full=F.col("confidence") >= 1, high=(F.col("confidence") >= LOW) & (F.col("confidence") < 1), low=(F.col("confidence") >= STALE) & (F.col("confidence") < LOW), lost=F.col("confidence") < STALE).first().asDict()
    e = rollup.condition_counts(edges, calls=F.lit(True), unresolved=F.col("callee_id").isNull(), ambiguous=F.col("is_ambiguous")).first().asDict()
    imports = files.agg(F.coalesce(F.sum(F.size("imports")), F.lit(0)).alias("n")).first()["n"]
    rest = {t: store.read(t).count() for t in ("dangers", "decisions", "changes", "taint_queue", "session_log", "directories")}
    languages = {r["language"] or "unknown": r["n"] for r in files.groupBy("language").agg(F.count("*").alias("n")).collect()}
    coverage = 100.0 * f["cached"] / f["files"] if f["files"] else 0.0
    return {**f, **g, **e, "imports": imports, **rest, "languages": languages, "coverage": coverage}


def status_text(figures: dict) -> str:
    order = ["files", "functions", "calls", "imports", "directories", "stale", "stale_functions", "tainted", "taint_queue", "unresolved", "ambiguous", "without_purpose", "dangers", "decisions", "changes", "session_log"]
    lines = ["Index status"] + [f"{k.replace('_', ' '):<18}{figures[k]:>10,}" for k in order]
    lines.append("confidence        " + ", ".join(f"{k} {figures[k]:,}" for k in ("full", "high", "low", "lost")))
    lines.append("languages         " + (", ".join(f"{k} {v:,}" for k, v in sorted(figures["languages"].items())) or "none"))
    lines.append(f"stat coverage     {figures['coverage']:.1f} %")
    return "\n".join(lines)


def search_rows(store: IndexStore, query: str, limit: int) -> list[tuple[str, str]]:
    """(id, text) of files by rank in the kept index, then files and functions by
    substring."""
    from quarrylight.operators import search

    limit = min(limit or search.LIMIT, search.MOST)
    files, functions = store.read("files"), store.read("functions")
    found: list[tuple[str, str]] = []
    for r in store.index().search(query, limit).join(files.select("path", "purpose"), "path", "left").orderBy(F.desc("score"), "path").collect():
        found.append((r["path"], r["purpose"] or ""))
    if not found:
        found += [(r["path"], r["purpose"] or "") for r in search.contains(files, query, ["purpose", "summary"]).orderBy("path").limit(limit).collect()]
    for columns in (["summary", "summary_long"], ["signature"]):
        found += [(r["id"], r["summary"] or r["signature"]) for r in search.contains(functions, query, columns).orderBy("id").limit(limit).collect()]
    first: dict[str, str] = {}
    for k, t in found:
        first.setdefault(k, t)
    return list(first.items())[:limit]
