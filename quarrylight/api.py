"""The tools: read and write access to an index, as texts.

Missing arguments give an error text; failures of writes are raised.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.scalar import source_slice
from quarrylight.operators import retention
from quarrylight.plans import context
from quarrylight.store import IndexStore


def need(**arguments) -> str | None:
    for name, value in arguments.items():
        if value in (None, ""):
            return f"Error: '{name}' argument is required."
    return None


def key_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:12]


TEXT, WHOLE, TEXTS = "string", "integer", "array"
#: Tools with their arguments: name -> (description, {argument: (type, what it
#: is)}, required arguments). Names and types are what clients send.
TOOLS = {
    "get_context": ("The ranked and budgeted document about a file.", {"file": (TEXT, "path in the repository"), "line": (WHOLE, "functions near this line come first")}, ["file"]),
    "get_function": ("All that is known of a function, with its source.", {"id": (TEXT, "path::name")}, ["id"]),
    "search": ("Files by full text, then files and functions by substring.", {"query": (TEXT, "what to look for"), "limit": (WHOLE, "10 by default, 50 at most")}, ["query"]),
    "get_dangers": ("Recorded dangers.", {"scope": (TEXT, "a path; global ones are always shown")}, []),
    "get_decisions": ("Recorded decisions with what was rejected.", {"scope": (TEXT, "a path; global ones are always shown")}, []),
    "get_callers": ("The functions that call a function.", {"function_id": (TEXT, "path::name")}, ["function_id"]),
    "get_tainted": ("Functions that depend on something changed.", {"file": (TEXT, "only those of a file")}, []),
    "ctx_status": ("Figures of the index.", {}, []),
    "update_file": ("Describes a file; it counts as fresh then.", {c: (TEXT, f"the file's {c.replace('_', ' ')}") for c in ("file", "purpose", "summary", "danger", "last_change", "system")}, ["file"]),
    "update_function": ("Describes a function; it counts as fresh and untainted then.", {**{c: (TEXT, f"the function's {c.replace('_', ' ')}") for c in ("id", "summary", "summary_long", "danger")}, "mutates": (TEXTS, "what it changes")}, ["id"]),
    "add_danger": ("Records a danger.", {"scope": (TEXT, "a path, or * for all"), "description": (TEXT, "the danger"), "reason": (TEXT, "why")}, ["description"]),
    "remove_danger": ("Removes a danger that a model has added.", {"id": (TEXT, "its id")}, ["id"]),
    "add_decision": ("Records a decision.", {"scope": (TEXT, "a path, or * for all"), "decision": (TEXT, "what was decided"), "alternatives": (TEXT, "what was rejected"), "reason": (TEXT, "why")}, ["decision"]),
    "log_session": ("Adds to the log of sessions, of which the last 10 stay.", {"entry": (TEXT, "what was done"), "files_touched": (TEXTS, "paths")}, ["entry"]),
    "log_change": ("Adds to the changes of a file, of which the last 20 stay.", {"file": (TEXT, "path"), "summary": (TEXT, "one sentence")}, ["file", "summary"]),
    "mark_tainted": ("Marks a function as suspect and queues it.", {"function_id": (TEXT, "path::name"), "taint_source": (TEXT, "what has changed")}, ["function_id", "taint_source"]),
    "clear_taint": ("Clears a function after review.", {"function_id": (TEXT, "path::name")}, ["function_id"]),
    "update_summary": ("Summarises a file or a function; it counts as fresh then.", {"type": (TEXT, "file (default) or function"), "id": (TEXT, "path or path::name"), "summary": (TEXT, "short text"), "summary_long": (TEXT, "long text; a file's purpose")}, ["id", "summary"]),
    "plan": ("Adds a plan to the log of sessions.", {"plan": (TEXT, "the plan"), "files_touched": (TEXTS, "paths")}, ["plan"]),
}


class CodeIndex:
    """All tools over one store; root is the repository it describes."""

    READ = ("get_context", "get_function", "search", "get_dangers", "get_decisions", "get_callers", "get_tainted", "ctx_status")
    WRITE = ("update_file", "update_function", "add_danger", "remove_danger", "add_decision", "log_session", "log_change", "mark_tainted", "clear_taint", "update_summary", "plan")

    def __init__(self, spark: SparkSession, store: IndexStore, root: str = "."):
        self.spark, self.store, self.root = spark, store, root

    def call(self, name: str, **arguments) -> str:
        """A tool by name; a failing read gives an error text."""
        if name in self.READ:
            try:
                return getattr(self, name)(**arguments)
            except Exception as problem:  # noqa: BLE001
                return f"Error: {problem}"
        if name in self.WRITE:
            with self.store.lock:
                return getattr(self, name)(**arguments)
        return f"Error: unknown tool '{name}'."

    def row(self, table: str, **keys):
        df = self.store.read(table)
        for c, v in keys.items():
            df = df.filter(F.col(c) == v)
        return df.first()

    def frame(self, table: str, *rows) -> DataFrame:
        return self.spark.createDataFrame(list(rows), self.store.read(table).schema)

    def now(self) -> dt.datetime:
        return dt.datetime.now(dt.timezone.utc)

    # --- reads

    def get_context(self, file: str | None = None, line: int | None = None) -> str:
        return need(file=file) or context.assemble(self.store, file, line)

    def get_function(self, id: str | None = None) -> str:
        if error := need(id=id):
            return error
        r = self.row("functions", id=id)
        if r is None:
            return f"Function '{id}' is not indexed."
        out = [f"# {r['id']}", *context.function_lines(r)]
        if r["is_tainted"]:
            out.append(f"Tainted by {r['taint_source'] or 'an unknown change'}")
        path = f"{self.root}/{r['file']}"
        try:
            text = self.spark.read.text(path, wholetext=True).select(source_slice(F.col("value"), F.lit(r["line_start"]), F.lit(r["line_end"])).alias("s"), F.sha2(F.col("value").cast("binary"), 256).alias("h")).first()
        except Exception:  # noqa: BLE001 - the file may be gone
            text = None
        if text is not None:
            known = self.row("files", path=r["file"])
            if known is not None and known["content_hash"] != text["h"]:
                out.append("Note: the file has changed since it was indexed; lines may be off.")
            out.append(text["s"])
        return "\n".join(out)

    def search(self, query: str | None = None, limit: int | None = None) -> str:
        if error := need(query=query):
            return error
        found = context.search_rows(self.store, query, limit)
        return "\n".join(f"{i}. {k}" + (f" — {t}" if t else "") for i, (k, t) in enumerate(found, 1)) or f"Nothing found for '{query}'."

    def scoped(self, table: str, scope: str | None) -> list:
        df = self.store.read(table)
        if scope:
            df = df.filter((F.col("scope") == scope) | F.col("scope").isNull() | (F.col("scope") == "*"))
        return df.orderBy(F.col("added_by").desc(), "scope", "id").collect()

    def get_dangers(self, scope: str | None = None) -> str:
        return "\n".join(f"[{r['scope'] or '*'}] {r['description']}" + (f" — {r['reason']}" if r["reason"] else "") for r in self.scoped("dangers", scope)) or "No dangers."

    def get_decisions(self, scope: str | None = None) -> str:
        return "\n".join(f"[{r['scope'] or '*'}] {r['decision']}" + (f" — {r['reason']}" if r["reason"] else "") + (f" (instead of {r['alternatives']})" if r["alternatives"] else "") for r in self.scoped("decisions", scope)) or "No decisions."

    def get_callers(self, function_id: str | None = None) -> str:
        if error := need(function_id=function_id):
            return error
        who = self.store.read("call_graph").filter(F.col("callee_id") == function_id).select(F.col("caller_id").alias("id")).distinct()
        rows = who.join(self.store.read("functions").select("id", "file", "signature", "summary"), "id").orderBy("file", "id").collect()
        return "\n".join(f"- {r['id']}: {r['signature']}" + (f" — {r['summary']}" if r["summary"] else "") for r in rows) or f"No callers of '{function_id}'."

    def get_tainted(self, file: str | None = None) -> str:
        df = self.store.read("functions").filter("is_tainted")
        if file:
            df = df.filter(F.col("file") == file)
        return "\n".join(f"- {r['id']} (source: {r['taint_source'] or 'unknown'})" for r in df.orderBy("file", "line_start").collect()) or "No tainted functions."

    def ctx_status(self) -> str:
        return context.status_text(context.status(self.store))

    # --- writes

    def merge(self, table: str, key: str, value: str, **columns) -> None:
        """Sets columns of one row."""
        self.store.commit(rows={table: self.with_columns(table, key, value, columns)})

    def with_columns(self, table: str, key: str, value: str, columns: dict) -> DataFrame:
        df = self.store.read(table)
        set_ = {c: (v if hasattr(v, "cast") else F.lit(v)).cast(df.schema[c].dataType) for c, v in columns.items()}
        return df.filter(F.col(key) == value).select(*[set_[c].alias(c) if c in set_ else F.col(c) for c in df.columns])

    def keys(self, column: str, *values: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{column} string")

    def patch_row(self, table: str, key: str, value: str, texts: dict, **fixed) -> None:
        """Non-empty texts replace what is there."""
        self.merge(table, key, value, **{c: t for c, t in texts.items() if t}, **fixed)

    def update_file(self, file=None, purpose=None, summary=None, danger=None, last_change=None, system=None) -> str:
        if error := need(file=file):
            return error
        if self.row("files", path=file) is None:
            return f"Error: file '{file}' is not indexed."
        self.patch_row("files", "path", file, {"purpose": purpose, "summary": summary, "danger": danger, "last_change": last_change, "system": system}, confidence=1.0, is_stale=False, updated_at=self.now())
        return f"Updated file '{file}'."

    def update_function(self, id=None, summary=None, summary_long=None, danger=None, mutates=None) -> str:
        if error := need(id=id):
            return error
        if self.row("functions", id=id) is None:
            return f"Error: function '{id}' is not indexed."
        fixed = {} if mutates is None else {"mutates": F.array(*map(F.lit, mutates)).cast("array<string>")}
        texts = {c: t for c, t in {"summary": summary, "summary_long": summary_long, "danger": danger}.items() if t}
        row = self.with_columns("functions", "id", id, {**texts, **fixed, "confidence": 1.0, "is_stale": False, "is_tainted": False, "taint_source": F.lit(None), "updated_at": self.now()})
        self.store.commit(rows={"functions": row}, gone={"taint_queue": self.keys("function_id", id)})
        return f"Updated function '{id}'."

    def update_summary(self, type="file", id=None, summary=None, summary_long=None) -> str:
        """A file's summary (and with a long text its purpose), or a function's."""
        if error := need(id=id, summary=summary):
            return error
        if type == "function":
            return self.update_function(id, summary=summary, summary_long=summary_long)
        return self.update_file(id, purpose=summary_long, summary=summary)

    def add(self, table: str, row: tuple, what: str) -> str:
        known = self.row(table, id=row[0]) is not None
        if not known:
            self.store.commit(rows={table: self.frame(table, row)})
        return f"{what} {'already known' if known else 'added'}: {row[0]}"

    def add_danger(self, description=None, scope="*", reason=None) -> str:
        if error := need(description=description):
            return error
        return self.add("dangers", (key_of(scope, description), scope, description, reason, "model", self.now()), "Danger")

    def remove_danger(self, id=None) -> str:
        if error := need(id=id):
            return error
        r = self.row("dangers", id=id)
        if r is None:
            return f"Error: no danger '{id}'."
        if r["added_by"] == "human":
            return f"Error: danger '{id}' was added by a human and stays."
        self.store.commit(gone={"dangers": self.keys("id", id)})
        return f"Danger removed: {id}"

    def add_decision(self, decision=None, reason=None, scope="*", alternatives=None) -> str:
        if error := need(decision=decision):
            return error
        return self.add("decisions", (key_of(scope, decision), scope, decision, alternatives, reason, "model", self.now()), "Decision")

    def log_session(self, entry=None, files_touched=None) -> str:
        if error := need(entry=entry):
            return error
        touched = ", ".join(files_touched) if isinstance(files_touched, (list, tuple)) else files_touched
        old, row = self.store.read("session_log"), self.frame("session_log", (uuid.uuid4().hex, entry, touched, self.now()))
        kept = retention.latest(old.unionByName(row), "timestamp", "id", retention.SESSIONS)
        self.store.commit(rows={"session_log": row}, gone={"session_log": old.join(kept.select("id"), "id", "left_anti")})
        return "Session logged."

    def plan(self, plan=None, files_touched=None) -> str:
        if error := need(plan=plan):
            return error
        return self.log_session(f"PLAN: {plan}", files_touched).replace("Session", "Plan")

    def log_change(self, file=None, summary=None) -> str:
        if error := need(file=file, summary=summary):
            return error
        old, row = self.store.read("changes").filter(F.col("file") == file), self.frame("changes", (file, uuid.uuid4().hex, summary, "model", self.now()))
        kept = retention.latest_per_key(old.unionByName(row), "file", "timestamp", "commit_hash", retention.CHANGES)
        self.store.commit(rows={"changes": row}, gone={"changes": old.join(kept.select("file", "commit_hash"), ["file", "commit_hash"], "left_anti")})
        return f"Change of '{file}' logged."

    def mark_tainted(self, function_id=None, taint_source=None) -> str:
        if error := need(function_id=function_id, taint_source=taint_source):
            return error
        r = self.row("functions", id=function_id)
        if r is None:
            return f"Error: function '{function_id}' is not indexed."
        if r["is_tainted"]:
            return f"Function '{function_id}' is tainted already."
        row = self.with_columns("functions", "id", function_id, {"is_tainted": True, "taint_source": taint_source})
        queued = {} if self.row("taint_queue", function_id=function_id) else {"taint_queue": self.frame("taint_queue", (function_id, taint_source, self.now(), 0))}
        self.store.commit(rows={"functions": row, **queued})
        return f"Function '{function_id}' marked as tainted."

    def clear_taint(self, function_id=None) -> str:
        if error := need(function_id=function_id):
            return error
        r = self.row("functions", id=function_id)
        if r is None or not r["is_tainted"]:
            return f"Error: function '{function_id}' is not tainted."
        row = self.with_columns("functions", "id", function_id, {"is_tainted": False, "taint_source": F.lit(None)})
        self.store.commit(rows={"functions": row}, gone={"taint_queue": self.keys("function_id", function_id)})
        return f"Taint of '{function_id}' cleared."

    def apply_answers(self, answers: DataFrame, column: str = "answer", confidence: float = 1.0) -> DataFrame:
        """Merges a summariser's answers; returns the errors."""
        from quarrylight.operators.summaries import parsed_answers

        rows = parsed_answers(answers, column).persist()
        good = rows.filter("error IS NULL AND path IS NOT NULL")
        files, functions = self.store.read("files"), self.store.read("functions")
        f = good.filter(F.coalesce("purpose_needs_update", F.lit(True))).select("path", *[F.col(c).alias(f"_{c}") for c in ("purpose", "summary", "danger")]).dropDuplicates(["path"])
        u = good.select(F.explode("functions").alias("f")).select(F.col("f.id").alias("id"), *[F.col(f"f.{c}").alias(f"_{c}") for c in ("summary", "summary_long", "danger")]).dropDuplicates(["id"])

        def merged(df, updates, key, texts, fixed):
            j = df.join(updates, key)
            new = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), df[c]) for c in texts} | {c: F.lit(v) for c, v in fixed.items()}
            return j.select(*[new[c].cast(df.schema[c].dataType).alias(c) if c in new else df[c] for c in df.columns])

        self.store.commit(
            rows={
                "files": merged(files, f, "path", ["purpose", "summary", "danger"], {"confidence": confidence, "is_stale": False}),
                "functions": merged(functions, u, "id", ["summary", "summary_long", "danger"], {"confidence": confidence, "is_stale": False, "is_tainted": False, "taint_source": None}),
            },
            gone={"taint_queue": u.select(F.col("id").alias("function_id"))},
        )
        errors = rows.filter("error IS NOT NULL").select("error")
        return errors
