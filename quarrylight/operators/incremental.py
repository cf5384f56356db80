"""Call resolution after a change: only what the change can reach is resolved again.

An edge depends on its own file, on the imports of that file, on what the imported
files define and show, and on how many functions bear its name. From the old and
the new state of the changed files come the keys that have moved; call sites that
look at such a key are affected, all others keep their edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import calls
from quarrylight.operators.graph import bearers
from quarrylight.scratch import settle as scratch_settle

PUSHED = calls.PUSHED


@dataclass
class CodeState:
    """What call resolution reads: see ``calls.resolve``."""

    functions: DataFrame
    imports: DataFrame
    import_edges: DataFrame
    exports: DataFrame
    supers: DataFrame

    def resolve(self, sites: DataFrame | None = None) -> DataFrame:
        return calls.resolve(self.functions, self.imports, self.import_edges, self.exports, self.supers, sites)


def only_keys(df: DataFrame, column: str, keys: DataFrame, most: int = PUSHED) -> DataFrame:
    """Rows whose column is among the (one-column) keys: a filter of the scan if
    they are few, else a join."""
    name = keys.columns[0]
    some = [r[0] for r in keys.distinct().limit(most + 1).collect()]
    if len(some) <= most:
        return df.filter(F.col(column).isin(some)) if some else df.filter("false")
    return df.join(keys.select(F.col(name).alias(column)).distinct(), column, "left_semi")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows that one side has and the other lacks."""
    old, new = old.distinct(), new.distinct().select(old.columns)
    sides = old.withColumn("_side", F.lit(1)).unionByName(new.withColumn("_side", F.lit(-1)))
    return sides.groupBy(*old.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").drop("_side")


def is_other() -> Column:
    """Calls through an object that is neither absent nor the caller itself."""
    return F.col("object").isNotNull() & ~F.col("object").isin(*calls.SELF)


@dataclass
class Moved:
    """What a change has moved; each is in the shared folder, so that few keys are
    broadcast and no call sites are moved to find them."""

    led: DataFrame  #: file: its imports lead elsewhere now
    reached: DataFrame  #: file, name, owner: an imported file defines or shows this no longer, or only now
    names: DataFrame  #: name, target (before): its answer for all files is another


def moved_keys(old: CodeState, new: CodeState, changed: DataFrame) -> Moved:
    """changed: file, for all files that were extracted again, are new or have
    vanished."""
    part = lambda df, column="file": only_keys(df, column, changed)
    old_functions, new_functions = (part(s.functions.select("id", "file", "class_name", "name")) for s in (old, new))
    functions = scratch_settle(moved(old_functions, new_functions), "moved")

    # Files whose imports lead elsewhere now: all their calls through objects.
    led = moved(old.import_edges.select("src", "dst"), new.import_edges.select("src", "dst")).select(F.col("src").alias("file")).distinct()
    # Names that an imported file has begun or ceased to define or show.
    shown = moved(part(old.exports.select("file", "name")), part(new.exports.select("file", "name"))).select(F.col("file").alias("target"), "name", F.lit(None).cast("string").alias("owner"))
    defined = functions.select(F.col("file").alias("target"), "name", F.col("class_name").alias("owner"))
    keys = scratch_settle(shown.unionByName(defined).distinct(), "moved")
    importers = new.import_edges.select(F.col("src").alias("file"), F.col("dst").alias("target"))
    reached = importers.join(keys, "target").select("file", "name", "owner").distinct()

    # Names whose answer for all files has moved.
    names = scratch_settle(functions.select("name").distinct(), "moved")
    answers = [scratch_settle(bearers(only_keys(s.functions.select("id", "name"), "name", names), "id", "name"), "moved") for s in (old, new)]
    known = moved(*answers).select("name").distinct().join(answers[0].select("name", "target"), "name", "left")
    return Moved(*[scratch_settle(x, "moved") for x in (led, reached, known)])


def affected_sites(old: CodeState, new: CodeState, old_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The call sites (as ``calls.call_sites``) of the new state whose edge may
    differ from the old one.

    changed: as in ``moved_keys``. The result may hold sites whose edge turns out
    the same.
    """
    keys = moved_keys(old, new, changed)
    led, reached = keys.led, keys.reached
    own = calls.call_sites(only_keys(new.functions, "file", changed))
    # Calls of names that have moved which no earlier rule has answered, by the old edges.
    open_ = only_keys(old_edges, "callee_name", keys.names.select("name")).join(keys.names.withColumnRenamed("name", "callee_name"), "callee_name", "left").filter("callee_id IS NULL OR callee_id = target").select("caller_id", "pos")

    files = led.unionByName(reached.select("file")).unionByName(open_.select(F.substring_index("caller_id", "::", 1).alias("file"))).distinct()
    near = calls.call_sites(only_keys(new.functions, "file", files.join(changed, "file", "left_anti"))).filter(is_other())
    by_led = near.join(led, "file", "left_semi")
    by_key = near.join(reached.withColumnRenamed("owner", "_owner"), ["file", "name"]).filter("_owner IS NULL OR _owner = object").drop("_owner")
    by_name = near.join(open_, ["caller_id", "pos"], "left_semi")
    columns = own.columns
    return own.unionByName(by_led.select(columns)).unionByName(by_key.select(columns)).unionByName(by_name.select(columns)).dropDuplicates(["caller_id", "pos"])


def edges_after(old: CodeState, new: CodeState, old_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """All edges after a change that may be large: those of untouched files and
    names as they were, the others resolved again.

    Touched files and names tell both which edges go and which sites are resolved,
    so that neither edges nor sites are moved to meet each other; a name that has
    moved takes along its calls that an earlier rule has answered."""
    keys = moved_keys(old, new, changed)
    files = scratch_settle(changed.unionByName(keys.led).unionByName(keys.reached.select("file")).distinct(), "moved").withColumn("_file", F.lit(True))
    names = keys.names.select("name").withColumn("_name", F.lit(True))
    kept = old_edges.withColumn("file", F.substring_index("caller_id", "::", 1)).join(files, "file", "left_anti").join(names.withColumnRenamed("name", "callee_name"), "callee_name", "left_anti")
    sites = calls.call_sites(new.functions).join(files, "file", "left").join(names, "name", "left").filter("_file OR _name")
    sites = scratch_settle(sites.select("caller_id", "file", "class_name", "pos", "name", "object"), "sites")
    return kept.select(old_edges.columns).unionByName(new.resolve(sites).select(old_edges.columns))


def edge_changes(old: CodeState, new: CodeState, old_edges: DataFrame, changed: DataFrame, settle) -> tuple[DataFrame, DataFrame]:
    """Edges to write and (caller_id, pos) of edges to drop, after a change.

    settle: writes a DataFrame and returns a read of it."""
    sites = settle(affected_sites(old, new, old_edges, changed))
    edges = settle(new.resolve(sites))
    file_of = F.substring_index("caller_id", "::", 1)
    stale = only_keys(old_edges.withColumn("_file", file_of), "_file", changed).select("caller_id", "pos")
    return edges, stale.join(edges.select("caller_id", "pos"), ["caller_id", "pos"], "left_anti")
