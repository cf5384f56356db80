"""One-hop taint: callers of what has changed or gone become suspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.graph import fan_in


def one_hop_taint(changed: DataFrame, edges: DataFrame, key: str = "id", caller: str = "caller_id", callee: str = "callee_id") -> DataFrame:
    """caller, taint_source, priority for each caller of a changed callee.

    The source is the greatest changed callee, so the result does not depend on
    order; the priority is the caller's own fan-in. A function that calls itself
    taints itself; callers of callers stay untouched.
    """
    hit = edges.join(changed.select(F.col(key).alias(callee)).distinct(), callee).groupBy(caller).agg(F.max(callee).alias("taint_source"))
    near = edges.join(hit.select(F.col(caller).alias(callee)), callee, "left_semi")
    priority = fan_in(near, callee, "priority").withColumnRenamed(callee, caller)
    return hit.join(priority, caller, "left").select(caller, "taint_source", F.coalesce("priority", F.lit(0)).cast("long").alias("priority"))


def removed_keys(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are not extracted any more."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def removed_taint(old: DataFrame, new: DataFrame, old_edges: DataFrame, key: str = "id", caller: str = "caller_id", callee: str = "callee_id") -> DataFrame:
    """Taint of the remaining callers of removed functions, from the edges as
    they were before the change."""
    gone = removed_keys(old, new, key)
    out = one_hop_taint(gone, old_edges, key, caller, callee)
    return out.join(new.select(F.col(key).alias(caller)).distinct(), caller, "left_semi")


def apply_taint(functions: DataFrame, taint: DataFrame, key: str = "id", caller: str = "caller_id") -> DataFrame:
    """Function rows with the taint set; others keep what they have."""
    t = taint.select(F.col(caller).alias(key), F.col("taint_source").alias("_source"))
    joined = functions.join(t, key, "left")
    hit = F.col("_source").isNotNull()
    return joined.select(*[F.when(hit, F.lit(True)).otherwise(functions[c]).alias(c) if c == "is_tainted" else F.when(hit, F.col("_source")).otherwise(functions[c]).alias(c) if c == "taint_source" else functions[c] for c in functions.columns])
