"""The index store: Parquet snapshots, row deltas on top of them, and one state.

A commit writes files under new names and then creates the next numbered state
file; a state that another process has created first is never replaced. Readers
see the state before or after, never a mix. A table is its base and the deltas
since: a commit of some rows costs these rows, reads merge, and deltas that have
grown are folded into a new base. The segments of the full-text index follow the
files in the same commit.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quarrylight import scratch
from quarrylight.operators import rowdeltas, segments
from quarrylight.schemas import KEYS, SEARCHED, TABLES, VERSION

STATE = re.compile(r"state-(\d+)\.json$")
KEPT = 3
#: Seconds that files which no recent state names stay for running readers.
GRACE = 3600
#: Every so many commits what nobody needs any more is removed.
TIDY = 8
#: Deltas are folded into the base when there are more of them, or when their rows
#: exceed this share of the base's.
MOST_DELTAS, SHARE, FEW_ROWS = 32, 0.2, 1000


class Conflict(RuntimeError):
    """Another process has committed since the state was read."""


class IndexStore:
    """Tables under a folder, or a URI, that all executors reach.

    tables, keys: schemas and key columns by name; searched: table, key and text
    columns of the full-text index, if any.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] = TABLES, keys: dict[str, list[str]] = KEYS, searched: tuple[str, str, list[str]] | None = ("files", "path", SEARCHED), grace: float = GRACE):
        self.spark, self.staged, self.tables, self.keys, self.searched, self.grace = spark, [], tables, keys, searched, grace
        self.root = root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)
        #: Held by whoever reads a table, changes it and commits it again.
        self.lock = threading.RLock()

    # --- states

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for name in scratch.children(self.spark, self.root) if (m := STATE.fullmatch(name)))

    def load(self, number: int) -> dict:
        return json.loads(scratch.read_text(self.spark, f"{self.root}/state-{number:010d}.json"))

    def state(self) -> dict:
        """number, tables (base, rows, deltas by name) and segments."""
        numbers = self.numbers()
        return self.load(numbers[-1]) if numbers else {"schema": VERSION, "number": 0, "tables": {}, "segments": []}

    def publish(self, state: dict) -> None:
        state = state | {"schema": VERSION, "number": state["number"] + 1}
        if not scratch.create_text(self.spark, f"{self.root}/state-{state['number']:010d}.json", json.dumps(state)):
            raise Conflict(f"state {state['number']} exists already")
        if state["number"] % TIDY == 0 or not self.grace:
            self.vacuum()

    # --- tables

    def path(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/{version}"

    def schema(self, name: str):
        return self.spark.createDataFrame([], self.tables[name]).schema

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """The table as of the last commit; empty before the first."""
        known = (state or self.state())["tables"].get(name)
        if known is None:
            return self.spark.createDataFrame([], self.tables[name])
        base = self.spark.read.schema(self.tables[name]).parquet(self.path(name, known["base"])) if known["base"] else self.spark.createDataFrame([], self.tables[name])
        if not known["deltas"]:
            return base
        changes = self.spark.read.schema(f"{self.tables[name]}, {rowdeltas.SEQ} long, {rowdeltas.GONE} boolean").parquet(*[self.path(name, v) for v, _ in known["deltas"]])
        return rowdeltas.merged(base, changes, self.keys[name])

    def write(self, name: str, df: DataFrame) -> tuple[str, int]:
        """A new version of a table: its name and number of rows."""
        version = uuid.uuid4().hex
        df.write.mode("error").parquet(self.path(name, version))
        return version, self.spark.read.schema(df.schema).parquet(self.path(name, version)).count()

    def commit(self, tables: dict[str, DataFrame] | None = None, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> None:
        """All changes at once: whole tables, rows that replace those of their
        keys, and keys that end.

        Row changes are repeated on top of what another process has committed
        meanwhile; whole tables are not (Conflict)."""
        tables, rows, gone = tables or {}, rows or {}, gone or {}
        with self.lock:
            while True:
                state = self.state()
                number = state["number"] + 1
                new = {**state, "tables": dict(state["tables"])}
                for name, df in tables.items():
                    version, n = self.write(name, df.select(self.schema(name).names))
                    new["tables"][name] = {"base": version, "rows": n, "deltas": []}
                for name in {**rows, **gone}:
                    new["tables"][name] = self.with_delta(name, new["tables"].get(name), rows.get(name), gone.get(name), number)
                self.follow(state, new, tables, rows, gone)
                try:
                    return self.publish(new)
                except Conflict:
                    if tables:
                        raise

    def with_delta(self, name: str, known: dict | None, rows: DataFrame | None, gone: DataFrame | None, number: int) -> dict:
        known = known or {"base": None, "rows": 0, "deltas": []}
        schema = self.schema(name)
        parts = [] if rows is None else [rowdeltas.as_upserts(rows, schema.names, number)]
        if gone is not None:
            parts.append(rowdeltas.as_tombstones(gone, self.keys[name], schema, number))
        version, n = self.write(name, reduce(DataFrame.unionByName, parts))
        out = {**known, "deltas": [*known["deltas"], [version, n]]} if n else known
        changed = sum(n for _, n in out["deltas"])
        if len(out["deltas"]) > MOST_DELTAS or changed > max(FEW_ROWS, SHARE * out["rows"]):
            return self.folded(name, out)
        return out

    def folded(self, name: str, known: dict) -> dict:
        version, n = self.write(name, self.read(name, {"tables": {name: known}}))
        return {"base": version, "rows": n, "deltas": []}

    def compact(self, *names: str) -> None:
        """Folds the deltas of tables (of all) into new bases, and the segments
        of the index into one."""
        with self.lock:
            state = self.state()
            new = {**state, "tables": dict(state["tables"])}
            for name in names or new["tables"]:
                if new["tables"][name]["deltas"]:
                    new["tables"][name] = self.folded(name, new["tables"][name])
            if self.searched and self.searched[0] in (names or new["tables"]) and len(state["segments"]) > 1:
                new["segments"] = [self.merged_segment(state["segments"])]
            self.publish(new)

    # --- the full-text index

    def index(self, state: dict | None = None) -> segments.Index:
        entries = (state or self.state())["segments"]
        _, key, _ = self.searched
        return segments.Index(self.spark, key, [(self.path("segments", e["version"]), e["seq"]) for e in entries])

    def follow(self, state: dict, new: dict, tables: dict, rows: dict, gone: dict) -> None:
        """Segments for what a commit changes in the searched table."""
        if not self.searched:
            return
        name, key, texts = self.searched
        number, version = state["number"] + 1, uuid.uuid4().hex
        if name in tables:
            docs = self.spark.read.schema(self.tables[name]).parquet(self.path(name, new["tables"][name]["base"]))
            n = segments.write(docs, None, self.path("segments", version), number, key, texts)
            new["segments"] = [{"version": version, "seq": number, "docs": n}]
        elif name in rows or name in gone:
            added = rows.get(name)
            keys = [x.select(key) for x in (added, gone.get(name)) if x is not None]
            old = self.read(name, state).join(reduce(DataFrame.unionByName, keys).distinct(), key, "left_semi")
            n = segments.write(added if added is not None else old.limit(0), old, self.path("segments", version), number, key, texts)
            new["segments"] = self.tidied([*state["segments"], {"version": version, "seq": number, "docs": n}])

    def tidied(self, entries: list[dict]) -> list[dict]:
        """Entries of which the newest are merged where there are many: from the
        first that is no larger than twice all after it."""
        if len(entries) <= segments.MOST:
            return entries
        at = next(i for i in range(len(entries)) if i == len(entries) - 2 or entries[i]["docs"] <= 2 * sum(e["docs"] for e in entries[i + 1 :]))
        return [*entries[:at], self.merged_segment(entries[at:], at > 0)]

    def merged_segment(self, entries: list[dict], older: bool = False) -> dict:
        version = uuid.uuid4().hex
        parts = segments.Index(self.spark, self.searched[1], [(self.path("segments", e["version"]), e["seq"]) for e in entries])
        n = parts.merge(self.path("segments", version), older)
        return {"version": version, "seq": entries[-1]["seq"], "docs": n}

    # --- scratch and cleaning

    def stage(self, df: DataFrame) -> DataFrame:
        """df written once to the shared folder and read back, so that what
        follows neither repeats it nor carries its plan along."""
        path = scratch.scratch_path(self.spark, "index")
        self.staged.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_stage(self) -> None:
        while self.staged:
            scratch.remove(self.spark, self.staged.pop())

    def vacuum(self) -> None:
        """Drops states but the latest, and versions that none of these names
        and that are older than the grace time."""
        numbers, keep = self.numbers(), set()
        for number in numbers[-KEPT:]:
            state = self.load(number)
            for name, known in state["tables"].items():
                keep |= {(name, v) for v in [known["base"], *[v for v, _ in known["deltas"]]] if v}
            keep |= {("segments", e["version"]) for e in state["segments"]}
        for number in numbers[:-KEPT]:
            scratch.remove(self.spark, f"{self.root}/state-{number:010d}.json")
        before = (time.time() - self.grace) * 1000
        for name in [*self.tables, "segments"]:
            for version, changed in scratch.children_times(self.spark, f"{self.root}/{name}"):
                if (name, version) not in keep and changed <= before:
                    scratch.remove(self.spark, f"{self.root}/{name}/{version}")
