"""Import resolution: raw import statements -> edges between files.

Each language turns a statement into candidate paths, every one with a group
and a priority; one equi-join with the known files decides, and the best
candidate of each group wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import normal_path, path_parent
from quarrylight.scratch import settle

#: Up to so many answers are broadcast, so that imports that very many files share
#: need no shuffle.
BROADCAST = 50_000
JS_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def folder(path: Column) -> Column:
    """The folder of a path; empty at the top level."""
    return F.when(F.instr(path, "/") > 0, path_parent(path)).otherwise("")


def under(base: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(name, F.lit("")))


def options(*paths: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("prio"), p.alias("candidate"), F.lit(None).cast("string").alias("item")) for i, p in enumerate(paths)])


def read_of(files: DataFrame) -> DataFrame:
    """The columns that ``resolve`` reads."""
    return files.select("path", "language", "exports", "imports_raw")


def statements(files: DataFrame) -> DataFrame:
    """path, language, no and the fields of every raw import."""
    return files.select("path", "language", F.posexplode("imports_raw").alias("no", "i")).select("path", "language", "no", "i.module", F.coalesce("i.names", F.array().cast("array<string>")).alias("names"), "i.level", "i.alias")


def rust_place(path: Column) -> Column:
    """The module of a Rust file, as a list."""
    inner = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.rs$", "")
    return F.filter(F.split(F.regexp_replace(inner, "(^|/)(mod|lib|main)$", ""), "/"), lambda x: x != "")


def rust_names() -> Column:
    """What a Rust statement names, from the outermost."""
    mod = F.filter(F.split(F.coalesce("module", F.lit("")), "::"), lambda x: x != "")
    return F.filter(F.concat(mod, F.col("names")), lambda x: x != "self")


def place() -> Column:
    """A path, real or not, that a statement means the same from as from its own,
    and that as many files as can share: candidates depend on the folder of
    relative imports alone, and for Rust on the module above."""
    beside = under(folder(F.col("path")), F.lit("x"))
    above = rust_place(F.col("path"))
    above = F.slice(above, F.lit(1), F.greatest(F.size(above) - 1, F.lit(0)))
    rust = F.concat(F.lit("src/"), F.array_join(F.concat(above, F.array(F.lit("x"))), "/"), F.lit(".rs"))
    return (
        F.when((F.col("language") == "python") & (F.col("level") > 0), beside)
        .when(F.col("language").isin("javascript", "typescript", "tsx") & F.col("module").startswith("."), beside)
        .when((F.col("language") == "rust") & (F.get(rust_names(), F.lit(0)) == "super"), rust)
        .otherwise("")
    )


def python_candidates(rows: DataFrame) -> DataFrame:
    rows = rows.filter("language = 'python'")
    module = F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(folder(F.col("path")), "/"), lambda x: x != "")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (F.col("level") - 1), F.lit(0))), "/")
    bases = F.when(F.col("level") > 0, F.array(under(up, module))).otherwise(F.array(module, under(F.lit("src"), module)))
    each = rows.select("path", "no", F.col("names"), F.posexplode(bases).alias("b", "base"))
    own = each.select("path", "no", F.concat(F.lit("m"), F.col("b")).alias("grp"), options(F.concat("base", F.lit(".py")), under(F.col("base"), F.lit("__init__.py"))).alias("opts"))
    sub = each.select("path", "no", "b", "base", F.explode("names").alias("name")).filter("name <> '*'")
    sub = sub.select("path", "no", F.concat(F.lit("n"), F.col("b"), F.col("name")).alias("grp"), options(F.concat(under(F.col("base"), F.col("name")), F.lit(".py")), F.concat(under(F.col("base"), F.col("name")), F.lit("/__init__.py"))).alias("opts"))
    return own.unionByName(sub)


def js_candidates(rows: DataFrame) -> DataFrame:
    rows = rows.filter("language IN ('javascript', 'typescript', 'tsx')").filter(F.col("module").startswith(".") | F.col("module").startswith("/"))
    base = normal_path(F.when(F.col("module").startswith("/"), F.col("module")).otherwise(F.concat_ws("/", folder(F.col("path")), F.col("module"))))
    return rows.select("path", "no", F.lit("js").alias("grp"), options(*[F.concat(base, F.lit(s)) for s in JS_SUFFIXES]).alias("opts"))


def rust_candidates(rows: DataFrame) -> DataFrame:
    """Longest module prefix first; what is left over must be one item that the
    file exports, or everything."""
    rows = rows.filter("language = 'rust'")
    own, full = rust_place(F.col("path")), rust_names()
    ups = F.size(F.filter(full, lambda x: x == "super"))
    rest = F.filter(full, lambda x: ~x.isin("crate", "super"))
    whole = F.when(F.get(full, F.lit(0)) == "super", F.concat(F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0))), rest)).otherwise(rest)
    rows = rows.select("path", "no", whole.alias("segs")).filter(F.size("segs") > 0)
    n = F.size("segs")
    each = rows.select("path", "no", "segs", F.explode(F.sequence(n, F.greatest(n - 1, F.lit(0)), F.lit(-1))).alias("k"))
    stem = F.array_join(F.slice("segs", F.lit(1), F.col("k")), "/")
    item = F.when(F.col("k") < n, F.element_at("segs", -1))
    places = F.when(F.col("k") > 0, F.array(F.concat(F.lit("src/"), stem, F.lit(".rs")), F.concat(F.lit("src/"), stem, F.lit("/mod.rs")))).otherwise(F.array(F.lit("src/lib.rs"), F.lit("src/main.rs")))
    opts = F.transform(places, lambda p, i: F.struct(((n - F.col("k")) * 2 + i).alias("prio"), p.alias("candidate"), item.alias("item")))
    return each.select("path", "no", F.lit("rs").alias("grp"), opts.alias("opts"))


def candidate_paths(rows: DataFrame) -> DataFrame:
    """path, no, grp, prio, candidate, item: every path that a statement may mean."""
    candidates = reduce(DataFrame.unionByName, [python_candidates(rows), js_candidates(rows), rust_candidates(rows)])
    return candidates.select("path", "no", "grp", F.explode("opts").alias("o")).select("path", "no", "grp", "o.prio", "o.candidate", "o.item")


def go_folders(rows: DataFrame, go_module: str) -> DataFrame:
    """path, dir: the folders of the module that Go files import."""
    m = F.col("module")
    inside = (m == go_module) | m.startswith(go_module + "/")
    return rows.filter("language = 'go'").filter(inside).select("path", F.expr(f"substring(module, {len(go_module) + 2})").alias("dir"))


def importers(files: DataFrame, changed: DataFrame, go_module: str | None = None) -> DataFrame:
    """path of every file with an import that may mean one of the changed paths
    (path), whether or not it does so now."""
    rows = statements(files)
    out = candidate_paths(rows).join(changed.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi").select("path")
    if go_module:
        folders = changed.select(folder(F.col("path")).alias("dir")).distinct()
        out = out.unionByName(go_folders(rows, go_module).join(folders, "dir", "left_semi").select("path"))
    return out.distinct()


def joined_with(df: DataFrame, answers: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """df with its answers. Where these are few, keys that very many rows of df
    share move no rows."""
    answers = settle(answers, "answers")
    return df.join(F.broadcast(answers) if answers.count() <= BROADCAST else answers, on, how)


def resolve(files: DataFrame, go_module: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Distinct edges src, dst between known files, without self-imports.

    files: path, language, exports, imports_raw. sources: the files (path) whose
    imports are wanted; all by default. Statements that mean the same are resolved
    once, however many files have them.
    """
    rows = statements(files if sources is None else files.join(sources.select("path").distinct(), "path", "left_semi"))
    rows = rows.withColumn("place", place())
    rows = rows.withColumn("key", F.to_json(F.struct("language", "place", "module", "names", "level")))
    known = files.select(F.col("path").alias("candidate"), "exports")
    each = candidate_paths(rows.dropDuplicates(["key"]).withColumns({"path": F.col("place"), "no": F.col("key")}))
    found = each.join(known, "candidate").filter(F.col("item").isNull() | (F.col("item") == "*") | F.array_contains("exports", F.col("item")))
    best = found.groupBy("no", "grp").agg(F.min_by("candidate", "prio").alias("dst")).select(F.col("no").alias("key"), "dst").distinct()
    edges = joined_with(rows.select(F.col("path").alias("src"), "key"), best, "key").select("src", "dst")
    if go_module:
        dirs = go_folders(rows, go_module)
        go = files.filter("language = 'go'").select(F.col("path").alias("dst"), folder(F.col("path")).alias("dir"))
        inside = joined_with(go, dirs.select("dir").distinct(), "dir", "left_semi")
        edges = edges.unionByName(joined_with(dirs, inside, "dir").select(F.col("path").alias("src"), "dst"))
    return edges.filter("src <> dst").distinct()


def with_imports(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files with sorted imports, used_by and used_by_count."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    back = edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("used_by"))
    empty = F.array().cast("array<string>")
    joined = files.drop("imports", "used_by", "used_by_count").join(out, "path", "left").join(back, "path", "left")
    return joined.withColumns({"imports": F.coalesce("imports", empty), "used_by": F.coalesce("used_by", empty)}).withColumn("used_by_count", F.size("used_by").cast("long"))
