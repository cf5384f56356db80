"""Repository -> index: the full and the incremental run, as one plan each."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import calls, delta, imports, incremental, retention, rollup, rowdeltas, taint
from quarrylight.sources import files as sources
from quarrylight.sources.extract import extract, extract_one, language_of
from quarrylight.store import IndexStore

FILE_META = ["system", "purpose", "summary", "danger", "last_change"]
FUNCTION_META = ["summary", "summary_long", "danger", "is_tainted", "taint_source"]
#: Errors that a report shows; ``failed`` counts all of them.
SHOWN = 100


@dataclass
class Report:
    """What a run has found and changed."""

    tracked: int = 0
    parsed: int = 0
    reused: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)
    functions: int = 0
    new: int = 0
    changed: int = 0
    removed: int = 0
    tainted: int = 0
    edges: int = 0
    unresolved: int = 0
    failed: int = 0
    #: Files with changed or new functions; of a run over named files, also the
    #: ids of these functions.
    touched: list[str] = field(default_factory=list)
    functions_touched: list[str] = field(default_factory=list)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def run(spark: SparkSession, root: str, store: IndexStore, full: bool = True, taint_new: bool = False, dry_run: bool = False, only: list[str] | None = None, purge: bool = False, now: dt.datetime | None = None) -> Report:
    """Brings the index up to date and reports.

    full: parse every file and make every edge again; else only files whose size
    or time of change differs, or, with ``only``, those named, and the edges that
    these can reach (``refresh``). All tables change in one commit; a dry run
    commits nothing. Files that have vanished turn stale, or go with ``purge``;
    their functions go. taint_new: callers of new functions too.
    """
    sources.assert_work_tree(root)
    if not full and "extracted" in store.state()["tables"]:
        return refresh(spark, root, store, taint_new, dry_run, only, purge, now)
    stamp, stage = F.lit(now or utc_now()), store.stage
    tracked = sources.tracked_paths(root)
    paths = sources.path_table(spark, [p for p in tracked if os.path.isfile(os.path.join(root, p))])
    mine = sources.parseable(paths)
    old_files, old_functions, old_edges, old_extracted = (store.read(t) for t in ("files", "functions", "call_graph", "extracted"))
    stats = stage(sources.scan(spark, root, mine, content=False))
    if full:
        todo = stats.select("path")
    elif only is not None:
        todo = stats.select("path").join(sources.path_table(spark, only), "path", "left_semi")
    else:
        hits = delta.cache_hits(stats, old_files, "path", "mtime", "file_size").filter("hit").join(old_extracted.select("path"), "path", "left_semi")
        todo = stats.select("path").join(hits, "path", "left_anti")
    todo = stage(todo)
    parsed = stage(extract(sources.scan(spark, root, todo)))

    ids = stage(calls.function_ids(parsed))
    gathered = ids.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("id", "class_name", "name", "calls")).alias("calls"))
    fresh = parsed.select("path", "language", "exports", "imports_raw", "supers").join(gathered, "path", "left").withColumn("calls", F.coalesce("calls", F.array().cast(gathered.schema["calls"].dataType)))
    kept = old_extracted.join(mine.select("path"), "path", "left_semi").join(todo, "path", "left_anti")
    extracted = stage(kept.unionByName(fresh.select(kept.columns)))

    edges = stage(imports.resolve(extracted, sources.go_module(root)))
    call_graph = stage(code_state(extracted, edges).resolve())

    # Files: what was parsed is merged, what was not is carried, what has gone turns stale.
    base = parsed.join(stats, "path").select("path", "language", "exports", "semantic_hash", "content_hash", "mtime", "file_size", "error", F.lit(True).alias("is_new"))
    merged = delta.carry_over(old_files, base.drop("is_new").withColumn("indexed_at", stamp), "path", "semantic_hash", FILE_META, stamp)
    rest = old_files.join(todo, "path", "left_anti")
    still = rest.join(mine.select("path"), "path", "left_semi")
    gone = rest.join(mine.select("path"), "path", "left_anti").withColumn("is_stale", F.lit(True))
    cols = [c for c in old_files.columns if c not in ("imports", "used_by", "used_by_count")]
    rows = merged.select(cols).unionByName(still.select(cols))
    files = imports.with_imports(rows if purge else rows.unionByName(gone.select(cols)), edges)

    # Functions of parsed files are merged by id; those of vanished files go.
    new_functions = ids.drop("calls").withColumn("is_tainted", F.lit(False)).withColumn("taint_source", F.lit(None).cast("string"))
    own = old_functions.join(todo.select(F.col("path").alias("file")), "file", "left_semi")
    merged_functions = delta.carry_over(own, new_functions.drop("is_tainted", "taint_source"), "id", "semantic_hash", FUNCTION_META, stamp)
    merged_functions = merged_functions.withColumn("is_tainted", F.coalesce("is_tainted", F.lit(False)))
    other = old_functions.join(todo.select(F.col("path").alias("file")), "file", "left_anti").join(mine.select(F.col("path").alias("file")), "file", "left_semi")
    functions = stage(merged_functions.select(old_functions.columns).unionByName(other.select(old_functions.columns)))

    diff = stage(delta.hash_diff(old_functions.withColumn("c", F.col("semantic_hash")), functions.withColumn("c", F.col("semantic_hash")), "id", "c", "semantic_hash"))
    hot = ["changed", "new"] if taint_new else ["changed"]
    touched = diff.filter(F.col("status").isin(hot)).select("id")
    removed = diff.filter("status = 'removed'").select("id")
    by_change = taint.one_hop_taint(touched, call_graph)
    by_removal = taint.one_hop_taint(removed, old_edges).join(functions.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")
    marks = stage(by_change.unionByName(by_removal).groupBy("caller_id").agg(F.max("taint_source").alias("taint_source"), F.max("priority").alias("priority")))
    functions_out = taint.apply_taint(functions, marks)
    queue_old = store.read("taint_queue")
    queue = queue_old.join(marks.select(F.col("caller_id").alias("function_id")), "function_id", "left_anti").join(functions.select(F.col("id").alias("function_id")), "function_id", "left_semi")
    queue = queue.unionByName(marks.select(F.col("caller_id").alias("function_id"), "taint_source", stamp.alias("queued_at"), "priority"))

    old_dirs = store.read("directories").select("path", "system", "summary")
    directories = rollup.directory_rollup(paths).join(old_dirs, "path", "left").withColumn("updated_at", stamp)

    counts = diff.groupBy("status").agg(F.count("*").alias("n")).collect()
    by = {r.status: r.n for r in counts}
    total = call_graph.agg(F.count("*").alias("n"), F.count_if(F.col("callee_id").isNull()).alias("open")).first()
    hit = diff.filter("status IN ('changed', 'new')").select("id", F.substring_index("id", "::", 1).alias("path"))
    broken = parsed.filter("error IS NOT NULL").select("path", "error")
    report = Report(
        tracked=len(tracked),
        parsed=parsed.count(),
        reused=kept.count(),
        errors=[(r.path, r.error) for r in broken.orderBy("path").limit(SHOWN).collect()],
        failed=broken.count(),
        touched=[r.path for r in hit.select("path").distinct().orderBy("path").collect()],
        functions_touched=[r.id for r in hit.orderBy("id").collect()] if only is not None else [],
        functions=sum(n for s, n in by.items() if s != "removed"),
        new=by.get("new", 0),
        changed=by.get("changed", 0),
        removed=by.get("removed", 0),
        tainted=marks.count(),
        edges=total.n,
        unresolved=total.open,
    )
    if not dry_run:
        store.commit({"files": files, "functions": functions_out, "call_graph": call_graph, "extracted": extracted, "taint_queue": queue, "directories": directories})
    store.clear_stage()
    return report


def code_state(extracted: DataFrame, import_edges: DataFrame) -> incremental.CodeState:
    """What call resolution reads, from extracted files."""
    functions = extracted.select("path", F.explode("calls").alias("f")).select("f.id", F.col("path").alias("file"), "f.class_name", "f.name", "f.calls")
    raw = extracted.select("path", F.explode("imports_raw").alias("i")).select("path", "i.module", "i.names", "i.alias")
    shown = extracted.select(F.col("path").alias("file"), F.explode("exports").alias("name"))
    supers = extracted.select(F.col("path").alias("file"), F.explode("supers").alias("s")).select("file", "s.class_name", "s.super")
    return incremental.CodeState(functions, raw, import_edges, shown, supers)


def refresh(spark: SparkSession, root: str, store: IndexStore, taint_new: bool = False, dry_run: bool = False, only: list[str] | None = None, purge: bool = False, now: dt.datetime | None = None) -> Report:
    """The incremental run: what has changed is parsed, imports that may mean a
    changed path and calls that look at a moved key are resolved again, and the
    commit holds the rows that differ. The result is that of a full run."""
    stamp, stage, state = F.lit(now or utc_now()), store.stage, store.state()
    tracked = sources.tracked_paths(root)
    paths = sources.path_table(spark, [p for p in tracked if os.path.isfile(os.path.join(root, p))])
    mine = sources.parseable(paths)
    old = {t: store.read(t, state) for t in ("files", "functions", "call_graph", "extracted", "taint_queue", "directories")}
    stats = stage(sources.scan(spark, root, mine, content=False))
    if only is not None:
        todo = stats.select("path").join(sources.path_table(spark, only), "path", "left_semi")
    else:
        hits = delta.cache_hits(stats, old["files"], "path", "mtime", "file_size").filter("hit").join(old["extracted"].select("path"), "path", "left_semi")
        todo = stats.select("path").join(hits, "path", "left_anti")
    todo = stage(todo)
    parsed = stage(extract(sources.scan(spark, root, todo)))
    ids = stage(calls.function_ids(parsed))
    gathered = ids.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("id", "class_name", "name", "calls")).alias("calls"))
    fresh = parsed.select("path", "language", "exports", "imports_raw", "supers").join(gathered, "path", "left").withColumn("calls", F.coalesce("calls", F.array().cast(gathered.schema["calls"].dataType)))
    fresh = stage(fresh.select(old["extracted"].columns))
    known = old["extracted"].select("path").unionByName(old["files"].filter(F.lit(purge) | ~F.col("is_stale")).select("path")).distinct()
    lost = stage(known.join(mine.select("path"), "path", "left_anti"))
    changed = stage(todo.unionByName(lost).distinct())
    folders = rollup.directory_rollup(paths)
    other = incremental.moved(old["directories"].select("path", "file_count"), folders.select("path", "file_count")).select("path").distinct()
    directories = folders.join(other, "path", "left_semi").join(old["directories"].select("path", "system", "summary"), "path", "left").withColumn("updated_at", stamp)
    no_folder = old["directories"].select("path").join(folders.select("path"), "path", "left_anti")
    if changed.isEmpty():
        total = old["call_graph"].agg(F.count("*").alias("n"), F.count_if(F.col("callee_id").isNull()).alias("open")).first()
        report = Report(tracked=len(tracked), reused=old["extracted"].count(), functions=old["functions"].count(), edges=total.n, unresolved=total.open)
        if not dry_run and not other.isEmpty():
            store.commit(rows={"directories": directories}, gone={"directories": no_folder})
        store.clear_stage()
        return report

    def after(table: str, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """A table as the commit will leave it."""
        changes = rowdeltas.as_upserts(rows, old[table].columns, 1).unionByName(rowdeltas.as_tombstones(gone, store.keys[table], old[table].schema, 1))
        return rowdeltas.merged(old[table], changes, store.keys[table])

    extracted = after("extracted", fresh, lost)
    module = sources.go_module(root)
    scope = stage(imports.importers(extracted, changed, module).unionByName(changed).distinct())
    edges_before = old["files"].select(F.col("path").alias("src"), F.explode("imports").alias("dst"))
    found = stage(imports.resolve(extracted, module, scope))
    edges = edges_before.join(scope.withColumnRenamed("path", "src"), "src", "left_anti").unionByName(found)
    was, is_now = code_state(old["extracted"], edges_before), code_state(extracted, edges)
    new_calls, gone_calls = incremental.edge_changes(was, is_now, old["call_graph"], changed.withColumnRenamed("path", "file"), stage)
    gone_calls = stage(gone_calls)
    call_graph = after("call_graph", new_calls, gone_calls)

    # Files: parsed ones are merged; of the others only those whose imports have moved are written.
    led = incremental.moved(edges_before, edges)
    touched = stage(changed.unionByName(led.select(F.col("src").alias("path"))).unionByName(led.select(F.col("dst").alias("path"))).distinct())
    base = parsed.join(stats, "path").select("path", "language", "exports", "semantic_hash", "content_hash", "mtime", "file_size", "error").withColumn("indexed_at", stamp)
    merged = delta.carry_over(old["files"].join(todo, "path", "left_semi"), base, "path", "semantic_hash", FILE_META, stamp)
    rest = old["files"].join(touched, "path", "left_semi").join(todo, "path", "left_anti")
    still, gone = rest.join(lost, "path", "left_anti"), rest.join(lost, "path", "left_semi").withColumn("is_stale", F.lit(True))
    cols = [c for c in old["files"].columns if c not in ("imports", "used_by", "used_by_count")]
    rows = merged.select(cols).unionByName(still.select(cols))
    near = edges.join(touched.withColumnRenamed("path", "src"), "src", "left_semi").unionByName(edges.join(touched.withColumnRenamed("path", "dst"), "dst", "left_semi")).distinct()
    files = stage(imports.with_imports(rows if purge else rows.unionByName(gone.select(cols)), near).select(old["files"].columns))

    # Functions of changed files: merged by id; ids that are not found again go.
    own = stage(old["functions"].join(changed.withColumnRenamed("path", "file"), "file", "left_semi"))
    merged_functions = delta.carry_over(own, ids.drop("calls"), "id", "semantic_hash", FUNCTION_META, stamp).withColumn("is_tainted", F.coalesce("is_tainted", F.lit(False)))
    merged_functions = stage(merged_functions.select(own.columns))
    diff = stage(delta.hash_diff(own.withColumn("c", F.col("semantic_hash")), merged_functions.withColumn("c", F.col("semantic_hash")), "id", "c", "semantic_hash"))
    hot = diff.filter(F.col("status").isin(["changed", "new"] if taint_new else ["changed"])).select("id")
    removed = diff.filter("status = 'removed'").select("id")
    functions = after("functions", merged_functions, removed)
    by_change = taint.one_hop_taint(hot, call_graph)
    by_removal = taint.one_hop_taint(removed, old["call_graph"]).join(functions.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")
    marks = stage(by_change.unionByName(by_removal).groupBy("caller_id").agg(F.max("taint_source").alias("taint_source"), F.max("priority").alias("priority")))
    marked = old["functions"].join(marks.select(F.col("caller_id").alias("id")), "id", "left_semi").join(own.select("id"), "id", "left_anti")
    function_rows = taint.apply_taint(merged_functions.unionByName(marked), marks)
    queue = marks.select(F.col("caller_id").alias("function_id"), "taint_source", stamp.alias("queued_at"), "priority")

    by = {r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    total = call_graph.agg(F.count("*").alias("n"), F.count_if(F.col("callee_id").isNull()).alias("open")).first()
    hit = diff.filter("status IN ('changed', 'new')").select("id", F.substring_index("id", "::", 1).alias("path"))
    broken = parsed.filter("error IS NOT NULL").select("path", "error")
    report = Report(
        tracked=len(tracked),
        parsed=parsed.count(),
        reused=old["extracted"].select("path").join(changed, "path", "left_anti").count(),
        errors=[(r.path, r.error) for r in broken.orderBy("path").limit(SHOWN).collect()],
        failed=broken.count(),
        touched=[r.path for r in hit.select("path").distinct().orderBy("path").collect()],
        functions_touched=[r.id for r in hit.orderBy("id").collect()] if only is not None else [],
        functions=functions.count(),
        new=by.get("new", 0),
        changed=by.get("changed", 0),
        removed=by.get("removed", 0),
        tainted=marks.count(),
        edges=total.n,
        unresolved=total.open,
    )
    if not dry_run:
        store.commit(
            rows={"files": files, "functions": function_rows, "call_graph": new_calls, "extracted": fresh, "taint_queue": queue, "directories": directories},
            gone={"functions": removed, "call_graph": gone_calls, "extracted": lost, "taint_queue": removed.withColumnRenamed("id", "function_id"), "directories": no_folder} | ({"files": lost} if purge else {}),
        )
    store.clear_stage()
    return report


def validate(spark: SparkSession, root: str, store: IndexStore, paths: list[str] | None = None) -> DataFrame:
    """path, status of staged files (or those named) against the index."""
    names = sources.staged_paths(root) if paths is None else paths
    rows = []
    for p in names:
        language = language_of(p)
        blob = sources.staged_blob(root, p) if language else None
        if language and blob is None and os.path.isfile(os.path.join(root, p)):
            with open(os.path.join(root, p), "rb") as f:
                blob = f.read()
        rows.append((p, extract_one(p, language, blob)["semantic_hash"] if language and blob is not None else None))
    staged = spark.createDataFrame(rows, "path string, semantic_hash string")
    return delta.validation(staged, store.read("files"), "path", "semantic_hash").orderBy("path")


def log_commit(spark: SparkSession, root: str, store: IndexStore, commit: str = "HEAD", now: dt.datetime | None = None) -> int:
    """Adds one change a file of the commit, once; keeps the latest per file."""
    subject, names = sources.commit_metadata(root, commit)
    full = sources.git(root, "rev-parse", commit).strip()
    old = store.read("changes")
    rows = spark.createDataFrame([(p, full, subject, "human", now or utc_now()) for p in names], old.schema)
    fresh = store.stage(rows.join(old.select("file", "commit_hash"), ["file", "commit_hash"], "left_anti"))
    n = fresh.count()
    if n:
        near = old.join(fresh.select("file").distinct(), "file", "left_semi").unionByName(fresh.select(old.columns))
        kept = store.stage(retention.latest_per_key(near, "file", "timestamp", "commit_hash", retention.CHANGES).select("file", "commit_hash"))
        key = ["file", "commit_hash"]
        store.commit(rows={"changes": fresh.join(kept, key, "left_semi")}, gone={"changes": near.select(key).join(kept, key, "left_anti")})
    store.clear_stage()
    return n
