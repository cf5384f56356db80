"""Keeping an index current from a stream of changed files."""

from __future__ import annotations

import datetime as dt
import logging
import os
import queue
import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.functions.scalar import source_slice
from quarrylight.plans import index
from quarrylight.sources import files as sources
from quarrylight.sources import llm_client
from quarrylight.sources.extract import EXTENSIONS, extract
from quarrylight.store import IndexStore
from quarrylight.streaming import daemon
from quarrylight.streaming.debounce import classify, event_filter
from quarrylight.streaming.producer import Producer

EVENTS = "ts timestamp, path string, kind string, is_directory boolean"
COUNTS = ("events", "deleted", "ignored", "unchanged", "formatting", "reindex")
#: Summaries that no person or large model has made are trusted less.
CONFIDENCE = 0.8
FUNCTION_PROMPT = "Summarise this function as a JSON list with one object: path, purpose_needs_update false, functions (id, summary, summary_long, danger)."
log = logging.getLogger("quarrylight.watch")


def summarise_functions(spark: SparkSession, store: IndexStore, root: str, ids: list[str], fn: Callable[[str], str]) -> int:
    """Summaries of some functions from their source; returns how many there are.
    A function that is gone, cannot be read or gets no usable answer is left."""
    from quarrylight.api import CodeIndex

    wanted = spark.createDataFrame([(i,) for i in ids], "id string")
    rows = store.read("functions").join(wanted, "id")
    text = sources.scan(spark, root, rows.select(F.col("file").alias("path")).distinct()).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    asked = rows.join(text, "file").select("id", F.to_json(F.struct("id", F.col("file").alias("path"), "signature", source_slice(F.col("text"), F.col("line_start"), F.col("line_end")).alias("source"))).alias("payload"))
    answers = llm_client.answers(asked, fn, FUNCTION_PROMPT, "id", "payload").persist()
    try:
        good = answers.filter("error IS NULL")
        with store.lock:
            CodeIndex(spark, store, root).apply_answers(good, confidence=CONFIDENCE)
        return good.count()
    finally:
        answers.unpersist()


class SummaryQueue:
    """Functions that wait for a summary, which a thread of its own makes."""

    def __init__(self, work: Callable[[list[str]], int]):
        self.work, self.waiting, self.done = work, queue.Queue(), 0
        self.thread = threading.Thread(target=self.run, daemon=True)
        self.thread.start()

    def enqueue(self, ids: list[str]) -> None:
        if ids:
            self.waiting.put(list(ids))

    def run(self) -> None:
        while (ids := self.waiting.get()) is not None:
            try:
                self.done += self.work(ids)
            except Exception as problem:  # noqa: BLE001 - the next ones may do
                log.warning("summaries of %s failed: %s", ids, problem)
            finally:
                self.waiting.task_done()
        self.waiting.task_done()

    def stop(self, patience: float = 5.0) -> None:
        """Ends after what is waiting."""
        self.waiting.put(None)
        self.thread.join(patience)


class Watcher:
    """A streaming query over event files (JSON lines of EVENTS).

    Every micro-batch is one flush: its distinct paths are classified against
    the index, and those whose substance has changed are indexed again with all
    passes. Progress lives in the query's checkpoint, the counters in the state
    file of ``folder``, from which a new watcher goes on.
    """

    def __init__(self, spark: SparkSession, root: str, store: IndexStore, events: str, checkpoint: str, folder: str | None = None, summaries: SummaryQueue | None = None):
        self.spark, self.root, self.store, self.events, self.checkpoint = spark, root, store, events, checkpoint
        self.folder, self.summaries = folder, summaries
        before = daemon.load(folder) if folder else {}
        self.counts = {c: int(before.get(c, 0)) for c in COUNTS}
        self.query: StreamingQuery | None = None

    def seen(self, paths: DataFrame) -> DataFrame:
        """The state on disk of the paths of a batch. Which of them are there is
        looked up by the driver: a flush holds the files of one burst of edits."""
        names = [r.path for r in paths.select("path").distinct().toLocalIterator()]
        there = [p for p in names if os.path.isfile(os.path.join(self.root, p))]
        known = {p: os.stat(os.path.join(self.root, p)) for p in there}
        rows = self.spark.createDataFrame([(p, p in known, known[p].st_mtime if p in known else None, known[p].st_size if p in known else None) for p in names], "path string, exists boolean, mtime double, file_size long")
        if not there:
            return rows.withColumns({"content_hash": F.lit(None).cast("string"), "semantic_hash": F.lit(None).cast("string")})
        files = self.spark.read.format("binaryFile").load([os.path.join(os.path.abspath(self.root), p) for p in there])
        base = len("file:") + len(os.path.abspath(self.root)) + 2
        hashes = extract(files.select(F.expr(f"substring(path, {base})").alias("path"), "content")).select("path", "content_hash", "semantic_hash")
        return rows.join(hashes, "path", "left")

    def flush(self, batch: DataFrame, _id: int) -> None:
        batch = batch.persist()
        self.counts["events"] += batch.count()
        wanted = event_filter(batch, list(EXTENSIONS)).select("path").distinct()
        actions = classify(self.seen(wanted), self.store.read("files")).persist()
        found = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        for action, n in found.items():
            self.counts[action] += n
        if found.get("deleted") or found.get("formatting"):
            with self.store.lock:
                now = actions.filter("action IN ('deleted', 'formatting')").select("path", (F.col("action") == "deleted").alias("_gone"), *[F.col(c).alias(f"_{c}") for c in ("content_hash", "mtime", "file_size")])
                # What was only laid out anew keeps its place in later runs.
                new = {"is_stale": F.col("_gone") | F.col("is_stale")} | {c: F.when(F.col("_gone"), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) for c in ("content_hash", "mtime", "file_size")}
                files = self.store.read("files")
                joined = files.join(now, "path")
                self.store.commit(rows={"files": joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in files.columns])})
        changed = [r.path for r in actions.filter("action = 'reindex'").select("path").collect()]
        if changed:
            with self.store.lock:
                report = index.run(self.spark, self.root, self.store, full=False, only=changed)
            if self.summaries:
                self.summaries.enqueue(report.functions_touched)
        actions.unpersist()
        batch.unpersist()
        if self.folder:
            daemon.save(self.folder, {**self.counts, "updated_at": dt.datetime.now(dt.timezone.utc).isoformat()})
        log.info("flush: %s", found)

    def start(self, once: bool = False) -> StreamingQuery:
        stream = self.spark.readStream.schema(EVENTS).json(self.events)
        writer = stream.writeStream.foreachBatch(self.flush).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        if self.summaries:
            self.summaries.stop()

    def status(self) -> dict:
        active = bool(self.query and self.query.isActive)
        return {"running": active, **self.counts, "last": self.query.lastProgress if self.query else None}


def watch(spark: SparkSession, root: str, store: IndexStore, folder: str, debounce: float, fn: Callable[[str], str] | None = None) -> None:
    """Looks at the repository and keeps its index current until SIGTERM or
    SIGINT. With ``fn`` what was indexed again is summarised too."""
    events = os.path.join(folder, "events")
    daemon.begin(folder)
    daemon.log_to(folder)
    ended = threading.Event()
    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, lambda *_: ended.set())
    summaries = SummaryQueue(lambda ids: summarise_functions(spark, store, root, ids, fn)) if fn else None
    watcher = Watcher(spark, root, store, events, os.path.join(folder, "checkpoint"), folder, summaries)
    producer = Producer(root, events, debounce)
    daemon.save(folder, {**watcher.counts, "updated_at": dt.datetime.now(dt.timezone.utc).isoformat()})
    try:
        watcher.start()
        producer.run(lambda: ended.is_set() or not watcher.query.isActive)
        if watcher.query.exception():
            raise watcher.query.exception()
    finally:
        watcher.stop()
        daemon.end(folder)
