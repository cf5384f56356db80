"""Change events: debounced flushes and what to do with each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.scratch import hadoop, scratch_path


def event_filter(events: DataFrame, extensions: list[str], root: str = "", path: str = "path", is_directory: str = "is_directory") -> DataFrame:
    """Events of parseable files under the root. Batch or stream."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    return events.filter(~F.col(is_directory) & ext.isin(extensions) & F.col(path).startswith(root))


def sessions(events: DataFrame, ts: str, path: str, gap: str, keys: list[str]) -> DataFrame:
    """keys, first_seen, n_events, paths: one row a flush, after ``gap`` of
    quiet; without keys one timer serves all events. Partial sessions are merged
    before the shuffle."""
    df = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if not keys:
        return whole_sessions(df, path, gap)
    window = F.session_window("_ts", F.lit(gap))
    out = df.groupBy(window.alias("session"), *keys).agg(F.min("_ts").alias("first_seen"), F.count("*").alias("n_events"), F.array_sort(F.collect_set(path)).alias("paths"))
    return out.select(*keys, "first_seen", "n_events", "paths")


def gap_micros(gap: str) -> Column:
    return F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + INTERVAL {gap}) - unix_micros(timestamp'1970-01-01 00:00:00')")


def whole_sessions(events: DataFrame, path: str, gap: str) -> DataFrame:
    """Sessions of all events (``_ts``) under one timer, of any length.

    Events of one interval of ``gap`` are of one session, so sessions are made of
    intervals: aggregated first, they are chained by their first and last event,
    and a session that holds all events is a row an interval to its task."""
    seconds = gap_micros(gap)
    slot = F.floor(F.unix_micros("_ts") / seconds).cast("long")
    each = events.filter("_ts IS NOT NULL").groupBy(slot.alias("_slot"), F.col(path).alias("_path")).agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"), F.count("*").alias("_n"))
    order = Window.orderBy("_slot")
    slots = each.groupBy("_slot").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    fresh = F.when(F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(order)) <= seconds, 0).otherwise(1)
    islands = slots.select("_slot", fresh.alias("_fresh")).select("_slot", F.sum("_fresh").over(order).alias("_island"))
    out = each.join(islands, "_slot").groupBy("_island").agg(F.min("_first").alias("first_seen"), F.sum("_n").alias("n_events"), F.array_sort(F.collect_set("_path")).alias("paths"))
    return out.select("first_seen", "n_events", "paths")


def stream_once(spark: SparkSession, path: str, schema, ts: str, name: str, gap: str, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    """All sessions of the events now at path, from a stream that stops at the
    end of its input (AvailableNow), with watermark ``delay``.

    Closed sessions are appended to files and leave the state. The sessions that
    are open when the input ends are flushed by one more event, far behind the
    last, which the stream reads from a file of its own; it closes all others and
    stays open itself.
    """
    folder = scratch_path(spark, "sessions")
    last = spark.read.schema(schema).parquet(path).agg(F.max(F.col(ts).cast("timestamp")).alias("t"))
    kinds = {f.name: f.dataType for f in schema}
    end = [F.expr(f"t + INTERVAL {gap} + INTERVAL {delay} + INTERVAL 1 DAY").alias(c) if c == ts else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    last.select(*end).write.parquet(f"{folder}/end")
    typed = [F.col(c).cast("timestamp").alias(c) if c == ts else F.col(c) for c in kinds]
    # A stream reads folders: a single file is taken by its name from its own.
    fs, p = hadoop(spark, path)
    one = fs.getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema)
    own = (reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString()) if one else reader.parquet(path)).select(*typed)
    closing = spark.readStream.schema(spark.read.parquet(f"{folder}/end").schema).parquet(f"{folder}/end").select(*typed)
    stream = own.unionByName(closing).withWatermark(ts, delay)
    window = F.session_window(ts, gap).alias("session")
    out = stream.groupBy(window, *[F.col(k) for k in keys]).agg(F.min(ts).alias("first_seen"), F.count("*").alias("n_events"), F.array_sort(F.collect_set(name)).alias("paths")).select(*keys, "first_seen", "n_events", "paths")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def classify(seen: DataFrame, index: DataFrame, path: str = "path") -> DataFrame:
    """path, action for changed paths: deleted (mark stale), ignored (not
    indexed), unchanged, formatting (refresh hashes only) or reindex."""
    i = index.select(path, F.col("content_hash").alias("_c"), F.col("semantic_hash").alias("_s"), F.lit(True).alias("_known"))
    action = (
        F.when(~F.col("exists"), "deleted")
        .when(F.col("_known").isNull(), "ignored")
        .when(F.col("_c").eqNullSafe(F.col("content_hash")), "unchanged")
        .when(F.col("_s").eqNullSafe(F.col("semantic_hash")), "formatting")
        .otherwise("reindex")
    )
    return seen.join(i, path, "left").withColumn("action", action).drop("_c", "_s", "_known")
