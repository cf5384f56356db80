"""Call resolution: call sites -> edges between functions, by seven rules.

Each rule answers some call sites; the first rule with an answer wins. Every
call site gives one edge, resolved or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.graph import ancestor_closure, bearers
from quarrylight.scratch import settle

SELF = ("self", "this", "cls")
#: Up to so many keys are handed to a scan as a filter, so that it can leave out
#: row groups.
PUSHED = 1000
ENTRIES = "array<struct<_kind:int,_scope:string,name:string,best:struct<rule:int,by:string,id:string>,pos:int,object:string>>"


def call_sites(functions: DataFrame) -> DataFrame:
    """caller_id, file, class_name, pos, name, object from functions with an
    array of calls."""
    return functions.select(F.col("id").alias("caller_id"), "file", "class_name", F.posexplode("calls").alias("pos", "c")).select("caller_id", "file", "class_name", "pos", "c.name", "c.object")


def class_chain(supers: DataFrame) -> DataFrame:
    """file, class_name, up, distance: all superclasses within a file, nearest
    first; a loop ends the chain."""
    pair = lambda name: F.struct("file", F.col(name).alias("name"))
    step = supers.filter("file IS NOT NULL AND class_name IS NOT NULL AND super IS NOT NULL").select(pair("class_name").alias("child"), pair("super").alias("parent"))
    return ancestor_closure(step, "child", "parent").select("node.file", F.col("node.name").alias("class_name"), F.col("ancestor.name").alias("up"), "distance")


def only_few(df: DataFrame, column: str, keys: DataFrame, most: int = PUSHED) -> DataFrame:
    """df, without rows of other keys (one column) if the keys are few: a filter
    that reaches the scan."""
    some = [r[0] for r in keys.distinct().limit(most + 1).collect()]
    if len(some) > most:
        return df
    return df.filter(F.col(column).isin(some)) if some else df.filter("false")


def asked(sites: DataFrame) -> DataFrame:
    """Sites with what their answer hangs on beside file and name: _kind (of the
    object: none, the caller itself, another) and _scope (the class asked)."""
    kind = F.when(F.col("object").isNull(), 0).when(F.col("object").isin(*SELF), 1).otherwise(2)
    scope = F.when(F.col("object").isNull(), "").when(F.col("object").isin(*SELF), F.col("class_name")).otherwise(F.col("object"))
    return sites.withColumn("_kind", kind).withColumn("_scope", scope)


def through_imports(other: DataFrame, defined: DataFrame, imports: DataFrame, import_edges: DataFrame, exports: DataFrame) -> DataFrame:
    """file, _scope, name, best (rule, by, id): answers of imported files, to calls
    through an object that an import has brought or that is a class."""
    last = F.element_at(F.split(F.regexp_replace("module", r"[/.]+$", ""), r"\.|/|::"), -1)
    handles = imports.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.concat(F.array("alias", F.nullif(last, F.lit(""))), F.coalesce("names", F.array().cast("array<string>"))))).alias("h"))
    # One row a file, so that what it asks is not moved to meet them.
    handles = handles.groupBy("file").agg(F.collect_set("h").alias("_handles"))
    led = import_edges.groupBy(F.col("src").alias("file")).agg(F.collect_set("dst").alias("_targets"))
    # Few classes are broadcast, so that other calls are not moved.
    classes = settle(defined.filter("class_name IS NOT NULL").select(F.col("class_name").alias("_scope")).distinct(), "classes").withColumn("_class", F.lit(True))
    asks = other.join(led, "file").join(handles, "file", "left").withColumn("_brought", F.array_contains("_handles", F.col("_scope"))).join(classes, "_scope", "left")
    asks = asks.filter("_brought OR _class").select("_brought", "_class", "_scope", "name", F.col("file").alias("_from"), F.explode("_targets").alias("file"))
    best = lambda rule: F.struct(F.lit(rule).alias("rule"), F.col("file").alias("by"), "id").alias("best")
    columns = [F.col("_from").alias("file"), "_scope", "name"]

    # Rule 4: a function that the file shows; rule 6: a method of the class.
    free = defined.filter("class_name IS NULL").select("file", "name", "id").join(exports.select("file", "name"), ["file", "name"], "left_semi")
    imported = asks.filter("_brought").select("file", "name", "_from", "_scope").join(free, ["file", "name"]).select(*columns, best(4))
    methods = defined.filter("class_name IS NOT NULL").select("file", F.col("class_name").alias("_scope"), "name", "id")
    far = asks.filter("_class").select("file", "name", "_from", "_scope").join(methods, ["file", "_scope", "name"]).select(*columns, best(6))
    return imported.unionByName(far)


def resolve(functions: DataFrame, imports: DataFrame, import_edges: DataFrame, exports: DataFrame, supers: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """caller_id, pos, callee_id, callee_name, callee_file, is_ambiguous,
    candidates for every call site, or those given.

    functions: id, file, class_name, name, calls. imports: path and the raw
    import's module, names, alias. exports: file, name. supers: file,
    class_name, super.

    All that is asked of a file meets in the task of that file: functions are moved
    with their calls as one row, a question that a file asks often is asked
    elsewhere once, and only what has an answer comes back.
    """
    f = functions.select("id", "file", "class_name", "name")
    none = F.lit(None).cast("string")
    if sites is None:
        nested = functions.select("file", "class_name", F.array_distinct(F.filter("calls", lambda c: c["object"].isNotNull())).alias("calls"))
        questions, anywhere = (df.select("file", "class_name", F.explode("calls").alias("c")).select("file", "class_name", "c.name", "c.object") for df in (nested.repartition("file"), nested))
        rows = functions.select("file", "class_name", "name", "id", F.lit(0).alias("_pos"), "calls")
    else:
        # Only what few sites can name takes part.
        names, files = sites.select("name"), sites.select("file")
        f, exports = only_few(f, "name", names), only_few(exports, "name", names)
        supers, import_edges, imports = only_few(supers, "file", files), only_few(import_edges, "src", files), only_few(imports, "path", files)
        anywhere = sites.filter("object IS NOT NULL").select("file", "class_name", "name", "object")
        questions = anywhere.repartition("file")
        rows = f.select("file", "class_name", "name", "id", F.lit(0).alias("_pos"), F.array().cast("array<struct<name:string,object:string>>").alias("calls"))
        rows = rows.unionByName(sites.select("file", "class_name", none.alias("name"), F.col("caller_id").alias("id"), F.col("pos").alias("_pos"), F.array(F.struct("name", "object")).alias("calls")))
    defined = f.filter("file IS NOT NULL AND name IS NOT NULL")
    questions = asked(questions).select("file", "_kind", "_scope", "name").distinct()
    own, other = (questions.filter(F.col("_kind") == k).drop("_kind") for k in (1, 2))
    best = lambda rule, by: F.struct(F.lit(rule).alias("rule"), by.alias("by"), "id").alias("best")

    # Rule 3: the nearest superclass.
    chain = class_chain(supers).select("file", F.col("class_name").alias("_scope"), F.col("up").alias("class_name"), "distance")
    up = own.join(chain, ["file", "_scope"]).join(defined, ["file", "class_name", "name"])
    inherited = up.groupBy("file", "_scope", "name").agg(F.min(F.struct("distance", "id")).alias("b")).withColumn("id", F.col("b.id")).select("file", F.lit(1).alias("_kind"), "_scope", "name", best(3, none))
    # Rules 4 and 6; rule 7: the only one of its name.
    imported = through_imports(other, defined, imports, import_edges, exports).select("file", F.lit(2).alias("_kind"), "_scope", "name", "best")
    named = settle(bearers(f, "id", "name"), "names")
    # Where these are few, they are broadcast.
    vague = settle(named.filter("is_ambiguous").select("name", F.col("candidates").alias("_c")), "names")
    only = asked(anywhere).filter("_kind = 2").select("file", "_scope", "name").join(vague.select("name"), "name", "left_anti").join(named.filter("target IS NOT NULL").select("name", F.col("target").alias("id")), "name")
    unique = only.select("file", F.lit(2).alias("_kind"), "_scope", "name", best(7, none))

    # Functions with their calls and the answers from elsewhere, by file.
    far = inherited.unionByName(imported).unionByName(unique)
    placed = rows.unionByName(far, allowMissingColumns=True).repartition("file")
    # Rules 1, 2 and 5: the file's own functions, methods of the class, and of another.
    entry = lambda kind, scope, name, best, pos=F.lit(None).cast("int"), object_=none: F.struct(kind.cast("int").alias("_kind"), scope.alias("_scope"), name.alias("name"), best.alias("best"), pos.alias("pos"), object_.alias("object"))
    here = lambda rule: F.struct(F.lit(rule).alias("rule"), none.alias("by"), F.col("id").alias("id"))
    method = [entry(F.lit(kind), F.col("class_name"), F.col("name"), here(rule)) for kind, rule in ((1, 2), (2, 5))]
    free = entry(F.lit(0), F.lit(""), F.col("name"), here(1))
    nothing = F.lit(None).cast("struct<rule:int,by:string,id:string>")
    called = F.transform("calls", lambda c, i: entry(F.lit(None), none, c["name"], nothing, (F.col("_pos") + i).cast("int"), c["object"]))
    given = F.when(F.col("name").isNull() | F.col("file").isNull(), F.array().cast(ENTRIES)).when(F.col("best").isNotNull(), F.array(entry(F.col("_kind"), F.col("_scope"), F.col("name"), F.col("best")))).when(F.col("class_name").isNull(), F.array(free)).otherwise(F.array(*method))
    entries = placed.select("file", "class_name", "id", F.explode(F.concat(given.cast(ENTRIES), F.coalesce(called.cast(ENTRIES), F.array().cast(ENTRIES)))).alias("e")).select("file", "class_name", F.col("id").alias("caller_id"), "e.*")
    entries = entries.withColumnRenamed("_kind", "_k").withColumnRenamed("_scope", "_s")
    entries = asked(entries).withColumn("_kind", F.when(F.col("pos").isNull(), F.col("_k")).otherwise(F.col("_kind"))).withColumn("_scope", F.when(F.col("pos").isNull(), F.col("_s")).otherwise(F.col("_scope")))
    answer = F.min("best").over(Window.partitionBy("file", "_kind", "_scope", "name"))
    joined = entries.select("file", "_kind", "_scope", "name", "best", "caller_id", "pos").withColumn("id", answer["id"]).filter("pos IS NOT NULL")
    joined = joined.select("caller_id", "pos", "name", "_kind", "id").join(vague.withColumnRenamed("name", "_name"), F.col("id").isNull() & (F.col("_kind") == 2) & (F.col("name") == F.col("_name")), "left")
    open_ = F.col("id").isNull() & F.col("_c").isNotNull()
    return joined.select("caller_id", "pos", F.col("id").alias("callee_id"), F.col("name").alias("callee_name"), F.when(F.col("id").isNotNull(), F.substring_index("id", "::", 1)).alias("callee_file"), open_.alias("is_ambiguous"), F.when(open_, F.col("_c")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def function_ids(files: DataFrame) -> DataFrame:
    """Function rows of extracted files with their ids: path::Class.name, and
    from the second of the same name on with the line behind."""
    rows = files.select(F.col("path").alias("file"), F.posexplode("functions").alias("no", "f")).select("file", "no", "f.*")
    qualified = F.concat(F.col("file"), F.lit("::"), F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."))).otherwise(""), F.col("name"))
    rows = rows.withColumn("id", qualified)
    nth = F.row_number().over(Window.partitionBy("file", "id").orderBy("no"))
    return rows.withColumn("_nth", nth).withColumn("id", F.when(F.col("_nth") > 1, F.concat("id", F.lit("@"), F.col("line_start").cast("string"))).otherwise(F.col("id"))).drop("_nth", "no")
