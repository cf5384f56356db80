"""Quiet times of changing paths, as a stateful stream.

For every key (a root, a user) the processor holds what has not come to rest: the
bursts of events that are still open, each with its paths and their last state. A
burst closes when the watermark has passed its last event by the quiet time; then
it goes out with the paths whose state differs from the one they were last seen
in, which is kept for as long as the key is in use.

Each use of the state is a message between Python and the JVM, so a key has one
value, read and written once a batch, and one timer: when it is due, all bursts
that the watermark has passed go out at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarrylight.scratch import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An open burst, in microseconds; ``paths`` holds path, time and state of the
#: last event of each path.
BURSTS = "bursts array<struct<first:long,last:long,n:long,paths:array<struct<path:string,at:long,state:string>>>>"
#: The value of a key: its timer in milliseconds, the end of the last burst that
#: has closed, the open bursts, and the states that paths were last seen in.
VALUE = f"due long, rested long, {BURSTS}, seen array<struct<path:string,state:string>>"
#: So many paths of a key are seen in its value; further ones in a map.
NEAR = 256


def absorbed(bursts: list[dict], at: int, path: str, state: str | None, gap: int) -> list[dict]:
    """bursts, in order and more than ``gap`` apart, with one more event."""
    return absorbed_all(bursts, [(at, path, state)], gap)


def absorbed_all(bursts: list[dict], events: list[tuple], gap: int) -> list[dict]:
    """bursts, in order and more than ``gap`` apart, with more events (at, path,
    state) in any order."""
    new = [{"first": at, "last": at, "n": 1, "paths": {path: (at, state or "")}} for at, path, state in events]
    out = []
    for b in sorted([*bursts, *new], key=lambda b: b["first"]):
        if not out or out[-1]["last"] + gap < b["first"]:
            out.append(b | {"paths": dict(b["paths"])})
            continue
        now = out[-1]
        now["last"], now["n"] = max(now["last"], b["last"]), now["n"] + b["n"]
        for p, x in b["paths"].items():
            now["paths"][p] = max(now["paths"].get(p, x), x)
    return out


class QuietPaths(StatefulProcessor):
    """Rows: (key, at in microseconds, path, state). A null state is empty. State
    of a key that has been quiet for ``expiry`` seconds goes."""

    def __init__(self, gap: float, expiry: float):
        self.gap, self.expiry = int(gap * 1e6), int(expiry * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", VALUE)
        self.far = handle.getMapState("seen", "path string", "state string")

    def load(self) -> tuple[int | None, int | None, list[dict], dict]:
        """Timer, end of the last closed burst, open bursts, states last seen."""
        found = self.value.get()
        if found is None:
            return None, None, [], {}
        due, rested, bursts, seen = found
        return due, rested, [{"first": b[0], "last": b[1], "n": b[2], "paths": {p[0]: (p[1], p[2]) for p in b[3]}} for b in bursts], {p[0]: p[1] for p in seen}

    def save(self, due: int | None, rested: int | None, bursts: list[dict], seen: dict, now: int) -> None:
        """Writes the value, with a timer at the next time that matters."""
        ends = [self.timer(b["last"] + self.gap) for b in bursts]
        wanted = min(ends) if ends else self.timer(rested + self.expiry)
        if due is None or due <= now or due > wanted:
            if due is not None and due > now:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
            due = wanted
        self.value.update((due, rested, [(b["first"], b["last"], b["n"], [(p, *x) for p, x in b["paths"].items()]) for b in bursts], list(seen.items())))

    def timer(self, at: int) -> int:
        """Milliseconds at which a time in microseconds is over."""
        return at // 1000 + 1

    def changes(self, seen: dict, path: str, state: str) -> bool:
        """Whether the path was last seen in another state; it is in this one now."""
        if path not in seen and len(seen) >= NEAR:
            known = self.far.getValue((path,)) if self.far.containsKey((path,)) else None
            if known is None or known[0] != state:
                self.far.updateValue((path,), (state,))
                return True
            return False
        if seen.get(path) == state:
            return False
        seen[path] = state
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, rested, bursts, seen = self.load()
        bursts = absorbed_all(bursts, [(row.at, row.path, row.state) for row in rows], self.gap)
        # A timer that is due already fires after the rows of this batch.
        self.save(due, rested, bursts, seen, -1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due, rested, bursts, seen = self.load()
        closed = [b for b in bursts if self.timer(b["last"] + self.gap) <= now]
        for b in closed:
            changed = [path for path, (_, state) in sorted(b["paths"].items()) if self.changes(seen, path, state)]
            rested = b["last"] if rested is None else max(rested, b["last"])
            yield Row(key=key[0], first_seen=b["first"], n_events=b["n"], paths=changed)
        left = bursts[len(closed) :]
        if not left and (rested is None or self.timer(rested + self.expiry) <= now):
            self.value.clear()
            if len(seen) >= NEAR:
                self.far.clear()
        else:
            self.save(due, rested, left, seen, now)

    def close(self) -> None:
        pass


def quiet_stream(events: DataFrame, key: str, ts: str, path: str, state: str, gap: float, expiry: float = 30 * 86400, delay: str = "10 seconds") -> DataFrame:
    """key, first_seen (microseconds), n_events, paths: the closed bursts of a
    stream of events. Late events, behind the watermark of ``delay``, are dropped
    by Spark."""
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(path).alias("path"), F.col(state).alias("state")).withWatermark("ts", delay)
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("at"), "path", "state")
    return rows.groupBy("key").transformWithState(QuietPaths(gap, expiry), f"key {kind}, first_seen long, n_events long, paths array<string>", "append", "EventTime")


def quiet_batch(events: DataFrame, key: str, ts: str, path: str, state: str, gap: float) -> DataFrame:
    """As quiet_stream over all events at once, by windows."""
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(path).alias("path"), F.coalesce(F.col(state), F.lit("")).alias("state"))
    order = Window.partitionBy("key").orderBy("at")
    fresh = F.when(F.col("at") - F.lag("at").over(order) <= int(gap * 1e6), 0).otherwise(1)
    bursts = rows.withColumn("_fresh", fresh).withColumn("burst", F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    each = bursts.groupBy("key", "burst", "path").agg(F.max(F.struct("at", "state")).alias("last"), F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.lag("last.state").over(Window.partitionBy("key", "path").orderBy("burst"))
    marked = each.withColumn("changed", F.coalesce(before != F.col("last.state"), F.lit(True)))
    out = marked.groupBy("key", "burst").agg(F.min("first").alias("first_seen"), F.sum("n").alias("n_events"), F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("path")))).alias("paths"))
    return out.select("key", "first_seen", "n_events", "paths")


def run_to_end(spark: SparkSession, parts: list[DataFrame], key: str, ts: str, path: str, state: str, gap: float) -> DataFrame:
    """All bursts of events that come in parts: the stream ends after each and
    starts again from its checkpoint. One more event, far behind the last, moves
    the watermark past what is open at the end."""
    folder = scratch_path(spark, "quiet")
    schema = parts[0].schema
    last = None
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for n in range(len(parts) + 1):
            if n < len(parts):
                parts[n].write.parquet(f"{folder}/in/{n}")
                top = spark.read.parquet(f"{folder}/in/{n}").agg(F.max(F.col(ts).cast("timestamp"))).first()[0]
                last = max(x for x in (last, top) if x is not None) if top or last else None
            elif last is not None:
                end = last + dt.timedelta(days=1, seconds=gap)
                spark.createDataFrame([(None,)], "x int").select(*[F.lit(end).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{folder}/in/{n}")
            else:
                break
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            out = quiet_stream(stream, key, ts, path, state, gap)
            query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
    if last is None:
        return spark.createDataFrame([], f"key {dict(parts[0].dtypes)[key]}, first_seen long, n_events long, paths array<string>")
    return spark.read.schema(out.schema).parquet(f"{folder}/out").filter("key IS NOT NULL")
