"""Registered queries over generated source files and a generated repository.

The tables hold no source code, so templates are filled in from them: a file a
customer in each language, and a small git repository from nations and regions.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import scalar as S
from quarrylight.operators import calls, imports
from quarrylight.plans import context, index
from quarrylight.plans.registry import load, query, spread
from quarrylight.scratch import scratch_path, settle
from quarrylight.sources import files as sources
from quarrylight.sources import llm_client
from quarrylight.sources.extract import extract
from quarrylight.store import IndexStore

JAVASCRIPT = """import { area as size, other } from './lib{n}.js';
import * as nat from './nat{n}';
import Def from "../x/def.js";
import React from 'react';
export class Shape extends Base {
  constructor(k) {
    this.k = k;
  }
  area(x) {
    this.total += {k};
    return size(this.k) + this.scale(x);
  }
  scale(x) { return x * {k}; }
}
export function free(a, b) {
  helper(a);
  return nat.area(b);
}
const helper = (x) => x + {k};
export const arrow = (x) => helper(x);
export default free;
"""
TYPESCRIPT = """import { Item } from './item{n}';
import { all } from './dir';
interface Box { size: number; }
type Id = string;
export class Store implements Box {
  private items: Item[] = [];
  async load(id: Id): Promise<Item> {
    this.items = await fetchAll(id);
    return this.find(id);
  }
  find(id: Id): Item { return this.items[{k}]; }
}
export const pick = (x: number): number => x + {k};
export enum Kind { A, B }
export function run<T>(x: T): T { return pick(x); }
"""
GO = """package shape

import (
	"fmt"
	lib "example.com/app/lib{n}"
)

type Server struct {
	Host string
}

func (s *Server) Start(port int) error {
	s.Host = fmt.Sprint(port)
	s.log()
	return lib.Open({k})
}

func (s Server) log() {}

func NewServer() *Server {
	return helper()
}

func helper() *Server { return nil }
"""
RUST = """use crate::lib{n}::{open, Handle};
use super::util;

pub struct Db { name: String }

impl Db {
    pub fn rename(&mut self, name: &str) {
        self.name = name.to_string();
        self.save({k});
    }
    fn save(&self, n: u32) -> u32 { open(n) }
}

pub fn start() -> Db {
    util::log();
    Db::new()
}

fn private() {}
"""
PYTHON = """from . import nat{n}
from .pkg import thing, other as o
from ..up import far
import os

__all__ = ["Shape", "free"]

class Base:
    def grow(self, by):
        return by

class Mid(Base):
    pass

class Shape(Mid):
    def size(self):
        global total
        total = {k}
        self.k = total
        return self.grow({k}) + free(self.k)
    def twice(self):
        return nat{n}.area(2) + Base.grow(self, 1)
    def twice(self):
        return any.only{k}() + any.both() + any.none()

def free(x):
    return x
"""
EXTENSION = {"javascript": "js", "typescript": "ts", "go": "go", "rust": "rs", "python": "py"}
TEMPLATE = {"javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST, "python": PYTHON}


def filled(text: str, **columns):
    """A template with {name} replaced by columns, as bytes."""
    out = F.lit(text)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out.cast("binary")


def customer_files(spark, d, language: str) -> DataFrame:
    """path, content: src/c<k>.<ext> for every customer."""
    path = F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit("." + EXTENSION[language]))
    return spread(load(spark, d, "customer"), "c_custkey").select(path.alias("path"), filled(TEMPLATE[language], k=F.col("c_custkey"), n=F.col("c_nationkey")).alias("content"))


def nation_files(spark, d, path: str, text: str) -> DataFrame:
    n = F.col("n_nationkey")
    return load(spark, d, "nation").select(filled(path, n=n).cast("string").alias("path"), filled(text, n=n).alias("content"))


def one_file(spark, path: str, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(path).alias("path"), F.lit(text).cast("binary").alias("content"))


def functions_sql(extension: str, rows: list[tuple]) -> str:
    """SQL for the rows (name, signature, first line, last line, mutates, calls)
    that every customer's file has."""
    quoted = ", ".join("('{}', '{}', {}, {}, '{}', '{}')".format(*(str(x).replace("'", "''") for x in r)) for r in rows)
    return f"""
SELECT 'src/c' || c_custkey || '.{extension}::' || replace(f.name, '{{k}}', c_custkey::VARCHAR) AS id, f.signature, f.line_start, f.line_end, f.mutates,
  replace(replace(f.calls, '{{k}}', c_custkey::VARCHAR), '{{n}}', c_nationkey::VARCHAR) AS calls
FROM customer, (VALUES {quoted}) f(name, signature, line_start, line_end, mutates, calls)
"""


def function_rows(spark, d, language: str) -> DataFrame:
    rows = calls.function_ids(extract(customer_files(spark, d, language), hashes=False))
    made = F.array_join(F.transform("calls", lambda c: F.concat_ws(".", c["object"], c["name"])), ",")
    return rows.select("id", "signature", "line_start", "line_end", F.array_join("mutates", ",").alias("mutates"), made.alias("calls"))


@query(functions_sql("js", [
    ("Shape.constructor", "constructor(k)", 6, 8, "this.k", ""),
    ("Shape.area", "area(x)", 9, 12, "", "size,this.scale"),
    ("Shape.scale", "scale(x)", 13, 13, "", ""),
    ("free", "function free(a, b)", 15, 18, "", "helper,nat.area"),
    ("helper", "(x) =>", 19, 19, "", ""),
    ("arrow", "(x) =>", 20, 20, "", "helper"),
]))
def extract_javascript(spark, d):
    return function_rows(spark, d, "javascript")


@query(functions_sql("ts", [
    ("Store.load", "async load(id: Id): Promise<Item>", 7, 10, "this.items", "fetchAll,this.find"),
    ("Store.find", "find(id: Id): Item", 11, 11, "", ""),
    ("pick", "(x: number): number =>", 13, 13, "", ""),
    ("run", "function run<T>(x: T): T", 15, 15, "", "pick"),
]))
def extract_typescript(spark, d):
    return function_rows(spark, d, "typescript")


@query(functions_sql("go", [
    ("Server.Start", "func (s *Server) Start(port int) error", 12, 16, "s.Host", "fmt.Sprint,s.log,lib.Open"),
    ("Server.log", "func (s Server) log()", 18, 18, "", ""),
    ("NewServer", "func NewServer() *Server", 20, 22, "", "helper"),
    ("helper", "func helper() *Server", 24, 24, "", ""),
]))
def extract_go(spark, d):
    return function_rows(spark, d, "go")


@query(functions_sql("rs", [
    ("Db.rename", "pub fn rename(&mut self, name: &str)", 7, 10, "self.name", "name.to_string,self.save"),
    ("Db.save", "fn save(&self, n: u32) -> u32", 11, 11, "", "open"),
    ("start", "pub fn start() -> Db", 14, 17, "", "util.log,Db.new"),
    ("private", "fn private()", 19, 19, "", ""),
]))
def extract_rust(spark, d):
    return function_rows(spark, d, "rust")


@query(functions_sql("py", [
    ("Base.grow", "def grow(self, by)", 9, 10, "", ""),
    ("Shape.size", "def size(self)", 16, 20, "global:total,self.k", "self.grow,free"),
    ("Shape.twice", "def twice(self)", 21, 22, "", "nat{n}.area,Base.grow"),
    ("Shape.twice@23", "def twice(self)", 23, 24, "", "any.only{k},any.both,any.none"),
    ("free", "def free(x)", 26, 27, "", ""),
]))
def extract_python(spark, d):
    """A second function of the same name gets its line into its id."""
    return function_rows(spark, d, "python")


@query("""
WITH t(ext, exports, imports, supers) AS (VALUES
  ('js', 'Shape,arrow,default,free', './lib{n}.js|area,other|0|size;./nat{n}|*|0|nat;../x/def.js|Def|0|-;react|React|0|-', 'Shape<Base'),
  ('ts', 'Kind,Store,pick,run', './item{n}|Item|0|-;./dir|all|0|-', ''),
  ('go', 'NewServer,Server', 'fmt||0|-;example.com/app/lib{n}||0|lib', ''),
  ('rs', 'Db,start', 'crate::lib{n}|open|0|-;crate::lib{n}|Handle|0|-;super|util|0|-', ''),
  ('py', 'Shape,free', '|nat{n}|1|-;pkg|thing,other|1|o;up|far|2|-;os||0|-', 'Mid<Base;Shape<Mid'))
SELECT 'src/c' || c_custkey || '.' || ext AS path, exports, replace(imports, '{n}', c_nationkey::VARCHAR) AS imports, supers FROM customer, t
""")
def file_exports_and_imports(spark, d):
    rows = None
    for language in EXTENSION:
        one = extract(customer_files(spark, d, language), hashes=False, functions=False)
        rows = one if rows is None else rows.unionByName(one)
    each = F.transform("imports_raw", lambda i: F.concat_ws("|", i["module"], F.array_join(i["names"], ","), i["level"].cast("string"), F.coalesce(i["alias"], F.lit("-"))))
    up = F.transform("supers", lambda s: F.concat_ws("<", s["class_name"], s["super"]))
    return rows.select("path", F.array_join(F.array_sort("exports"), ",").alias("exports"), F.array_join(each, ";").alias("imports"), F.array_join(F.array_sort(up), ";").alias("supers"))


def edges_with(spark, d, language: str, others: list[DataFrame], go_module: str | None = None) -> DataFrame:
    files = customer_files(spark, d, language)
    for other in others:
        files = files.unionByName(other)
    return imports.resolve(settle(imports.read_of(extract(files, hashes=False, functions=False)), "parsed"), go_module)


@query("""
SELECT 'src/c' || c_custkey || '.py' AS src, unnest(['src/nat' || c_nationkey || '.py', 'src/pkg/__init__.py', 'up.py']) AS dst FROM customer
""")
def import_edges_relative(spark, d):
    """One dot, a package, two dots; what is not in the repository gives none."""
    plain = "def area(x):\n    return x\n"
    return edges_with(spark, d, "python", [nation_files(spark, d, "src/nat{n}.py", plain), one_file(spark, "src/pkg/__init__.py", "thing = 1\n"), one_file(spark, "up.py", plain), one_file(spark, "pkg.py", plain)])


@query("""
SELECT 'src/c' || c_custkey || '.js' AS src, unnest(['src/lib' || c_nationkey || '.js', 'src/nat' || c_nationkey || '.ts', 'x/def.js']) AS dst FROM customer
""")
def import_edges_javascript(spark, d):
    """A full name, a suffix to be tried, a folder above, a package."""
    text = "export function area(x) { return x; }\n"
    return edges_with(spark, d, "javascript", [nation_files(spark, d, "src/lib{n}.js", text), nation_files(spark, d, "src/nat{n}.ts", text), nation_files(spark, d, "src/nat{n}.js.ts", text), one_file(spark, "x/def.js", text), one_file(spark, "src/react.js", text)])


@query("""
SELECT 'src/c' || c_custkey || '.ts' AS src, unnest(['src/item' || c_nationkey || '.tsx', 'src/dir/index.ts']) AS dst FROM customer
""")
def import_edges_typescript(spark, d):
    text = "export function all(x) { return x; }\n"
    return edges_with(spark, d, "typescript", [nation_files(spark, d, "src/item{n}.tsx", text), one_file(spark, "src/dir/index.ts", text), one_file(spark, "src/dir/index.js", text)])


@query("""
SELECT 'src/c' || c_custkey || '.go' AS src, unnest(['lib' || c_nationkey || '/a.go', 'lib' || c_nationkey || '/b.go']) AS dst FROM customer
""")
def import_edges_go(spark, d):
    """A package is all files of its folder, but not of folders below."""
    text = "package lib\n\nfunc Open(x int) error { return nil }\n"
    return edges_with(spark, d, "go", [nation_files(spark, d, f"lib{{n}}/{p}.go", text) for p in ("a", "b", "deep/c")], "example.com/app")


@query("""
SELECT 'src/c' || c_custkey || '.rs' AS src, unnest(['src/lib' || c_nationkey || '.rs', 'src/util.rs']) AS dst FROM customer
""")
def import_edges_rust(spark, d):
    text = "pub fn open(n: u32) -> u32 { n }\npub struct Handle {}\n"
    return edges_with(spark, d, "rust", [nation_files(spark, d, "src/lib{n}.rs", text), one_file(spark, "src/util.rs", "pub fn log() {}\n"), one_file(spark, "src/lib.rs", text)])


@query("""
WITH c AS (SELECT 'src/c' || c_custkey || '.py::' AS f, c_custkey AS k, c_nationkey AS n FROM customer),
b AS (SELECT string_agg(id, ',' ORDER BY id) AS five FROM (SELECT 'src/nat' || n_nationkey || '.py::Z.both' AS id FROM nation ORDER BY id LIMIT 5))
SELECT f || 'Shape.size' AS caller_id, 0 AS pos, f || 'Base.grow' AS callee_id, false AS is_ambiguous, '' AS candidates FROM c
UNION ALL SELECT f || 'Shape.size', 1, f || 'free', false, '' FROM c
UNION ALL SELECT f || 'Shape.twice', 0, 'src/nat' || n || '.py::area', false, '' FROM c
UNION ALL SELECT f || 'Shape.twice', 1, f || 'Base.grow', false, '' FROM c
UNION ALL SELECT f || 'Shape.twice@23', 0, 'src/o' || k || '.py::only' || k, false, '' FROM c
UNION ALL SELECT f || 'Shape.twice@23', 1, NULL, true, five FROM c, b
UNION ALL SELECT f || 'Shape.twice@23', 2, NULL, false, '' FROM c
""")
def call_rules(spark, d):
    """Same file, a class two levels up, an imported module, a named class, the
    only function of a name, several of them, none."""
    own = spread(load(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("src/o"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), filled("def only{k}():\n    return 1\n", k=F.col("c_custkey")).alias("content"))
    text = "def area(x):\n    return x\n\nclass Z:\n    def both(self):\n        return 1\n"
    files = settle(extract(customer_files(spark, d, "python").unionByName(own).unionByName(nation_files(spark, d, "src/nat{n}.py", text)), hashes=False), "parsed")
    functions = calls.function_ids(files)
    raw = files.select("path", F.explode("imports_raw").alias("i")).select("path", "i.module", "i.names", "i.alias")
    shown = files.select(F.col("path").alias("file"), F.explode("exports").alias("name"))
    supers = files.select(F.col("path").alias("file"), F.explode("supers").alias("s")).select("file", "s.class_name", "s.super")
    out = calls.resolve(functions, raw, imports.resolve(files), shown, supers)
    return out.select("caller_id", "pos", "callee_id", "is_ambiguous", F.array_join("candidates", ",").alias("candidates"))


VARIANTS = {
    "base": "class A:\n    def f(self, x):\n        return x + {n}\n\ndef g(y):\n    return 'a'\n",
    "layout": "class A:\n\n    def f( self,x ):\n\n        return x+{n}\n\n\n\ndef g(y): return 'a'\n",
    "comments": "# one\nclass A:\n    # two\n    def f(self, x):\n        return x + {n}  # three\n\ndef g(y):\n    return 'a'\n",
    "docstrings": '"""Module."""\nclass A:\n    """Class."""\n    def f(self, x):\n        """Function."""\n        return x + {n}\n\ndef g(y):\n    return \'a\'\n',
    "quotes": "class A:\n    def f(self, x):\n        return x + {n}\n\ndef g(y):\n    return \"a\"\n",
    "logic": "class A:\n    def f(self, x):\n        return x - {n}\n\ndef g(y):\n    return 'a'\n",
    "rename": "class A:\n    def f(self, z):\n        return z + {n}\n\ndef g(y):\n    return 'a'\n",
    "text": "class A:\n    def f(self, x):\n        return x + {n}\n\ndef g(y):\n    return 'b'\n",
}


@query("""
SELECT 'v/' || v || n_nationkey || '.py' AS path, v NOT IN ('logic', 'rename', 'text') AS same_file, v NOT IN ('logic', 'rename') AS same_f, v <> 'text' AS same_g, v = 'base' AS same_bytes
FROM nation, (VALUES ('base'), ('layout'), ('comments'), ('docstrings'), ('quotes'), ('logic'), ('rename'), ('text')) t(v)
""")
def semantic_hash_invariance(spark, d):
    """Whether a variant of a file, and each function, keeps the base's hash."""
    rows = None
    for name, text in VARIANTS.items():
        one = nation_files(spark, d, f"v/{name}{{n}}.py", text).withColumn("v", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    n = F.regexp_extract("path", r"(\d+)\.py$", 1)
    hash_of = lambda f: F.filter("functions", lambda x: x["name"] == f)[0]["semantic_hash"]
    found = settle(extract(rows), "parsed").select("path", n.alias("n"), "content_hash", "semantic_hash", hash_of("f").alias("f"), hash_of("g").alias("g"))
    base = found.filter(F.col("path").startswith("v/base")).select("n", *[F.col(c).alias(f"b_{c}") for c in ("content_hash", "semantic_hash", "f", "g")])
    return found.join(base, "n").select("path", (F.col("semantic_hash") == F.col("b_semantic_hash")).alias("same_file"), (F.col("f") == F.col("b_f")).alias("same_f"), (F.col("g") == F.col("b_g")).alias("same_g"), (F.col("content_hash") == F.col("b_content_hash")).alias("same_bytes"))


@query("""
WITH e AS (SELECT ['py', 'js', 'jsx', 'mjs', 'ts', 'tsx', 'go', 'rs', 'txt', 'PY'][c_custkey % 10 + 1] AS ext FROM customer)
SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'javascript' END AS language, count(*)::BIGINT AS n
FROM e WHERE ext NOT IN ('txt', 'PY') GROUP BY 1
""")
def language_counts(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("py", "js", "jsx", "mjs", "ts", "tsx", "go", "rs", "txt", "PY")])
    paths = load(spark, d, "customer").select(F.concat(F.lit("a.b/c"), F.col("c_custkey").cast("string"), F.lit("."), F.get(kinds, (F.col("c_custkey") % 10).cast("int"))).alias("path"))
    return sources.language_counts(paths)


@query("""
SELECT c_custkey, 'a, b, c' AS head, split_part('s/c' || c_custkey || '.py::C.f', '::', 1) AS file,
  '[{"path": "' || c_custkey || '"}]' AS answer FROM customer
""")
def list_and_answer_texts(spark, d):
    """The head of a list, the file of a function id, an answer without its fence."""
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit('[{"path": "'), k, F.lit('"}]'))
    fenced = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  ```\n"), body, F.lit("```  "))).otherwise(body)
    return load(spark, d, "customer").select("c_custkey", S.head_list(F.array(*map(F.lit, "abcd")), 3).alias("head"), S.file_of(F.concat(F.lit("s/c"), k, F.lit(".py::C.f"))).alias("file"), S.stripped_answer(fenced).alias("answer"))


# --- a repository -----------------------------------------------------------

SHARED = "import base\n\ndef grow(x):\n    return base.area(x) + {r}\n"
NATION = "from . import shared\nimport base\n\nclass Nation:\n    def size(self):\n        self.k = {n}\n        return shared.grow(self.k) + self.twice()\n    def twice(self):\n        return base.scale({n})\n"
BASE = "def area(x):\n    return x\n\ndef scale(x):\n    return area(x) * 2\n"
PAGE = "import {{ run }} from './lib';\nexport function page() {{ return run({r}); }}\n"
_made: dict[tuple, tuple[IndexStore, str, dict]] = {}


def git(root: str, *args: str) -> None:
    sources.git(root, "-c", "user.name=quarrylight", "-c", "user.email=q@example.org", "-c", "commit.gpgsign=false", *args)


def write(root: str, path: str, text: str) -> None:
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)


def repository(spark, d) -> tuple[IndexStore, str, dict]:
    """An index of a repository of a file a nation and a region, after a first
    run, a change in the files of region 0 and of the base, and a second run; the
    store, the root, and the reports of both runs. Made once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key in _made:
        return _made[key]
    root = scratch_path(spark, "repository").removeprefix("file://")
    nations = sorted((r.n_nationkey, r.n_regionkey) for r in load(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    regions = sorted({r for _, r in nations})
    write(root, "base.py", BASE)
    write(root, "web/lib.ts", "export function run(x) { return x; }\n")
    write(root, "notes.txt", "text\n")
    for r in regions:
        write(root, f"r{r}/shared.py", SHARED.format(r=r))
        write(root, f"web/r{r}.ts", PAGE.format(r=r))
    for n, r in nations:
        write(root, f"r{r}/n{n}.py", NATION.format(n=n))
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "All files")
    store = IndexStore(spark, f"{root}.index")
    first = index.run(spark, root, store)
    store.commit({"functions": store.read("functions").withColumn("is_stale", F.lit(False)), "files": store.read("files").withColumn("is_stale", F.lit(False))})
    # The base's area changes, its layout too; a page's bytes alone; one nation goes.
    write(root, "base.py", BASE.replace("return x\n", "return x + 1  # more\n", 1))
    write(root, "web/r1.ts", PAGE.format(r=1) + "// a remark\n")
    os.remove(os.path.join(root, "r0", f"n{min(n for n, r in nations if r == 0)}.py"))
    second = index.run(spark, root, store, full=False)
    _made[key] = (store, root, {"first": first, "second": second})
    return _made[key]


GONE = "(SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 0)"
FILES_SQL = f"""
SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, 'python' AS language, CASE WHEN n_nationkey = {GONE} THEN '' ELSE 'base.py,r' || n_regionkey || '/shared.py' END AS imports, 0::BIGINT AS used_by_count,
  n_nationkey = {GONE} AS is_stale, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'r' || r_regionkey || '/shared.py', 'python', 'base.py', (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> {GONE}), false, 1.0 FROM region
UNION ALL SELECT 'web/r' || r_regionkey || '.ts', 'typescript', 'web/lib.ts', 0, false, 1.0 FROM region
UNION ALL SELECT 'web/lib.ts', 'typescript', '', (SELECT count(*) FROM region), false, 1.0
UNION ALL SELECT 'base.py', 'python', '', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) - 1, true, 0.85
"""


@query(FILES_SQL)
def index_files(spark, d):
    """Tracked and parsed files with their imports: unchanged ones keep their
    confidence, the changed one decays, the vanished one is stale."""
    store, _, _ = repository(spark, d)
    return store.read("files").select("path", "language", F.array_join("imports", ",").alias("imports"), "used_by_count", "is_stale", F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH n AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py::Nation.' AS p FROM nation WHERE n_nationkey <> {GONE}), r AS (SELECT r_regionkey AS k FROM region)
SELECT p || 'size' AS id, 'def size(self)' AS signature, 'self.k' AS mutates, false AS is_stale, 1.0::DOUBLE AS confidence, false AS is_tainted, '' AS taint_source FROM n
UNION ALL SELECT p || 'twice', 'def twice(self)', '', false, 1.0, false, '' FROM n
UNION ALL SELECT 'r' || k || '/shared.py::grow', 'def grow(x)', '', false, 1.0, true, 'base.py::area' FROM r
UNION ALL SELECT 'web/r' || k || '.ts::page', 'function page()', '', false, 1.0, false, '' FROM r
UNION ALL SELECT 'web/lib.ts::run', 'function run(x)', '', false, 1.0, false, ''
UNION ALL SELECT 'base.py::area', 'def area(x)', '', true, 0.85, false, ''
UNION ALL SELECT 'base.py::scale', 'def scale(x)', '', false, 1.0, true, 'base.py::area'
""")
def index_functions(spark, d):
    store, _, _ = repository(spark, d)
    return store.read("functions").select("id", "signature", F.array_join("mutates", ",").alias("mutates"), "is_stale", F.round("confidence", 6).alias("confidence"), "is_tainted", F.coalesce("taint_source", F.lit("")).alias("taint_source"))


@query(f"""
WITH n AS (SELECT 'r' || n_regionkey AS r, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS p FROM nation WHERE n_nationkey <> {GONE}), r AS (SELECT r_regionkey AS k FROM region)
SELECT p || '::Nation.size' AS caller_id, 0 AS pos, r || '/shared.py::grow' AS callee_id, r || '/shared.py' AS callee_file FROM n
UNION ALL SELECT p || '::Nation.size', 1, p || '::Nation.twice', p FROM n
UNION ALL SELECT p || '::Nation.twice', 0, 'base.py::scale', 'base.py' FROM n
UNION ALL SELECT 'r' || k || '/shared.py::grow', 0, 'base.py::area', 'base.py' FROM r
UNION ALL SELECT 'web/r' || k || '.ts::page', 0, NULL, NULL FROM r
UNION ALL SELECT 'base.py::scale', 0, 'base.py::area', 'base.py'
""")
def index_calls(spark, d):
    store, _, _ = repository(spark, d)
    return store.read("call_graph").select("caller_id", "pos", "callee_id", "callee_file")


@query(f"""
SELECT '.' AS path, (SELECT count(*) FROM nation) - 1 + 2 * (SELECT count(*) FROM region) + 3 AS file_count
UNION ALL SELECT 'web', (SELECT count(*) FROM region) + 1
UNION ALL SELECT 'r' || r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> {GONE}) + 1 FROM region
""")
def index_directories(spark, d):
    store, _, _ = repository(spark, d)
    return store.read("directories").select("path", "file_count")


@query(f"""
SELECT 'r' || r_regionkey || '/shared.py::grow' AS function_id, 'base.py::area' AS taint_source, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> {GONE})::BIGINT AS priority FROM region
UNION ALL SELECT 'base.py::scale', 'base.py::area', (SELECT count(*) FROM nation) - 1
""")
def index_taint_queue(spark, d):
    store, _, _ = repository(spark, d)
    return store.read("taint_queue").select("function_id", "taint_source", "priority")


@query(f"""
WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r)
SELECT 'first' AS run, 2 + n + 2 * r + 1 AS tracked, 2 + n + 2 * r AS parsed, 0 AS reused, 2 * n + 2 * r + 3 AS functions, 2 * n + 2 * r + 3 AS new, 0 AS changed, 0 AS removed, 0 AS tainted, r AS unresolved FROM c
UNION ALL SELECT 'second', 2 + n + 2 * r + 1, 2, 2 + n + 2 * r - 3, 2 * n + 2 * r + 1, 0, 1, 2, r + 1, r FROM c
""")
def index_reports(spark, d):
    """What the runs tell: the second parses the changed files alone."""
    _, _, reports = repository(spark, d)
    names = ["tracked", "parsed", "reused", "functions", "new", "changed", "removed", "tainted", "unresolved"]
    return spark.createDataFrame([(k, *(int(getattr(r, n)) for n in names)) for k, r in reports.items()], "run string, " + ", ".join(f"{n} long" for n in names))


@query("""
SELECT 'web/lib.ts' AS path, 'stale' AS status UNION ALL SELECT 'web/r2.ts', 'checked' UNION ALL SELECT 'web/new.go', 'not_indexed' UNION ALL SELECT 'notes.txt', 'skipped'
""")
def staged_validation(spark, d):
    """Staged blobs against the index: what is on disk since does not count."""
    store, root, _ = repository(spark, d)
    write(root, "web/lib.ts", "export function run(x) { return x * 2; }\n")
    write(root, "web/r2.ts", PAGE.format(r=2) + "// only a remark\n")
    write(root, "web/new.go", "package a\nfunc F() {}\n")
    write(root, "notes.txt", "other\n")
    names = ["web/lib.ts", "web/r2.ts", "web/new.go", "notes.txt"]
    git(root, "add", *names)
    write(root, "web/r2.ts", PAGE.format(r=99))
    try:
        rows = [(r.path, r.status) for r in index.validate(spark, root, store).select("path", "status").collect()]
    finally:
        git(root, "reset", "-q", "--hard", "HEAD")
        write(root, "base.py", BASE.replace("return x\n", "return x + 1  # more\n", 1))
    return spark.createDataFrame(rows, "path string, status string")


@query("""
WITH f AS (
  SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS file FROM nation UNION ALL SELECT 'r' || r_regionkey || '/shared.py' FROM region UNION ALL SELECT 'web/r' || r_regionkey || '.ts' FROM region
  UNION ALL SELECT unnest(['base.py', 'notes.txt', 'web/lib.ts'])
)
SELECT file, 'All files' AS summary, 'human' AS author, 1::BIGINT AS n FROM f
""")
def logged_commit(spark, d):
    """The changes of the first commit, logged twice: once a file."""
    store, root, _ = repository(spark, d)
    for _ in range(2):
        index.log_commit(spark, root, store, sources.git(root, "rev-list", "--max-parents=0", "HEAD").strip())
    return store.read("changes").filter("author = 'human'").groupBy("file", "summary", "author").agg(F.count("*").alias("n"))


def describe(prompt: str) -> str:
    """A summariser that needs no model: it tells what it was asked about."""
    files = json.loads(prompt[prompt.index("\n[") + 1 :])
    rows = [{"path": f["path"], "purpose": f"about {f['path']}", "summary": f"{len(f['members'])} functions", "functions": [{"id": m["id"], "summary": f"does {m['id']}"} for m in f["members"]]} for f in files]
    return "```json\n" + json.dumps(rows) + "\n```"


@query("""
SELECT 'files' AS kind, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS id, 'about r' || n_regionkey || '/n' || n_nationkey || '.py' AS text, 1.0::DOUBLE AS confidence, false AS is_stale FROM nation
UNION ALL SELECT 'functions', 'r' || n_regionkey || '/n' || n_nationkey || '.py::Nation.' || f, 'does r' || n_regionkey || '/n' || n_nationkey || '.py::Nation.' || f, 1.0, false FROM nation, (VALUES ('size'), ('twice')) t(f)
""")
def summarised_files(spark, d):
    """Answers of a summariser, in batches, merged into files and functions."""
    from quarrylight import cli

    rows = load(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    store = IndexStore(spark, scratch_path(spark, "summaries"))
    empty = {t: store.read(t) for t in ("files", "functions")}
    null = lambda t, known: [F.lit(None).cast(f.dataType).alias(f.name) for f in empty[t].schema if f.name not in known]
    files = rows.select("path", F.lit(0.3).alias("confidence"), F.lit(True).alias("is_stale"), *null("files", {"path", "confidence", "is_stale"}))
    functions = rows.select(F.explode(F.array(*[F.concat("path", F.lit(f"::Nation.{f}")) for f in ("size", "twice")])).alias("id"), F.col("path").alias("file"), F.lit(0.3).alias("confidence"), F.lit(True).alias("is_stale"), F.lit(False).alias("is_tainted"), *null("functions", {"id", "file", "confidence", "is_stale", "is_tainted"}))
    store.commit({"files": files, "functions": functions})
    llm_client.register_summarizer(describe, "describe")
    cli.summarise(spark, store, 7, False, False, name="describe")
    shown = lambda t, key, text: store.read(t).select(F.lit(t).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"), "confidence", "is_stale")
    return shown("files", "path", "purpose").unionByName(shown("functions", "id", "summary"))


# --- the tools --------------------------------------------------------------


def tool_store(spark, d, name: str):
    """The tools over a store of its own: nations as functions, which all call
    the function of their region."""
    from quarrylight.api import CodeIndex

    store = IndexStore(spark, scratch_path(spark, name))
    empty = {t: store.read(t) for t in ("files", "functions", "call_graph")}

    def rows(t: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty[t].schema])

    n, r = load(spark, d, "nation"), load(spark, d, "region")
    nation = n.select(F.format_string("n/%02d.py", "n_nationkey").alias("file"), F.lower("n_name").alias("name"), F.format_string("r%d.py", "n_regionkey").alias("home"))
    region = r.select(F.format_string("r%d.py", "r_regionkey").alias("file"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("name"))
    own = nation.select("file", F.replace("name", F.lit(" "), F.lit("_")).alias("name"), "home")
    functions = own.select("file", "name").unionByName(region).select(F.concat_ws("::", "file", "name").alias("id"), "file", "name", F.concat(F.lit("def "), F.col("name"), F.lit("()")).alias("signature"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit(0.4).alias("confidence"), F.lit(True).alias("is_stale"), F.lit(False).alias("is_tainted"))
    edges = own.join(region.withColumnsRenamed({"file": "home", "name": "callee"}), "home").select(F.concat_ws("::", "file", "name").alias("caller_id"), F.lit(0).alias("pos"), F.concat_ws("::", "home", "callee").alias("callee_id"), F.col("callee").alias("callee_name"), F.col("home").alias("callee_file"), F.lit(False).alias("is_ambiguous"))
    files = own.select("file", "home").unionByName(region.select("file", F.lit(None).cast("string").alias("home"))).select(F.col("file").alias("path"), F.lit("python").alias("language"), F.lit(0.4).alias("confidence"), F.lit(True).alias("is_stale"), F.when(F.col("home").isNotNull(), F.array("home")).otherwise(F.array().cast("array<string>")).alias("imports"))
    store.commit({"files": rows("files", files), "functions": rows("functions", functions), "call_graph": rows("call_graph", edges)})
    return CodeIndex(spark, store, "/nowhere")


@query("""
WITH n AS (SELECT printf('n/%02d.py::%s', n_nationkey, replace(lower(n_name), ' ', '_')) AS id, replace(lower(n_name), ' ', '_') AS name, n_regionkey AS r FROM nation),
r AS (SELECT 'r' || r_regionkey || '.py::' || replace(lower(r_name), ' ', '_') AS id, r_regionkey AS r FROM region)
SELECT r.id, string_agg('- ' || n.id || ': def ' || n.name || '()', chr(10) ORDER BY n.id) AS text FROM r JOIN n ON n.r = r.r GROUP BY r.id
UNION ALL SELECT 'zz', 'No callers of ''zz''.' UNION ALL SELECT '', 'Error: ''function_id'' argument is required.'
""")
def tool_callers(spark, d):
    tools = tool_store(spark, d, "tool-callers")
    names = [r.id for r in tools.store.read("functions").filter("file LIKE 'r%'").select("id").orderBy("id").collect()]
    return spark.createDataFrame([(n, tools.call("get_callers", function_id=n)) for n in [*names, "zz", ""]], "id string, text string")


@query("""
WITH n AS (SELECT printf('n/%02d.py', n_nationkey) AS path, printf('n/%02d.py::%s', n_nationkey, replace(lower(n_name), ' ', '_')) AS id, n_nationkey AS k FROM nation)
SELECT path AS id, CASE WHEN k < 3 THEN 'p' || k END AS text, NULL AS more, CASE WHEN k < 3 THEN 'sys' END AS tag, CASE WHEN k < 3 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS confidence, k >= 3 AS is_stale, false AS is_tainted FROM n
UNION ALL SELECT id, CASE WHEN k < 5 THEN 's' || k END, CASE WHEN k < 3 THEN 'a,b' END, NULL, CASE WHEN k < 5 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END, k >= 5, k = 7 FROM n
""")
def tool_updates(spark, d):
    """update_file, update_function, update_summary, mark_tainted, clear_taint."""
    tools = tool_store(spark, d, "tool-updates")
    names = {int(r.file[2:4]): r.id for r in tools.store.read("functions").filter("file LIKE 'n/%'").select("file", "id").collect()}
    for k in range(3):
        tools.call("update_file", file=f"n/{k:02d}.py", purpose=f"p{k}", system="sys", last_change="now")
        tools.call("update_file", file=f"n/{k:02d}.py", purpose="")
        tools.call("mark_tainted", function_id=names[k], taint_source="x")
        tools.call("update_function", id=names[k], summary=f"s{k}", mutates=["a", "b"])
    for k in (3, 4):
        tools.call("update_summary", type="function", id=names[k], summary=f"s{k}")
    tools.call("mark_tainted", function_id=names[6], taint_source="x")
    tools.call("mark_tainted", function_id=names[7], taint_source="x")
    tools.call("clear_taint", function_id=names[6])
    files = tools.store.read("files").filter("path LIKE 'n/%'").select(F.col("path").alias("id"), F.col("purpose").alias("text"), F.lit(None).cast("string").alias("more"), F.col("system").alias("tag"), "confidence", "is_stale", F.lit(False).alias("is_tainted"))
    functions = tools.store.read("functions").filter("file LIKE 'n/%'").select("id", F.col("summary").alias("text"), F.when(F.size("mutates") > 0, F.array_join("mutates", ",")).alias("more"), F.lit(None).cast("string").alias("tag"), "confidence", "is_stale", "is_tainted")
    return files.unionByName(functions)


@query("""
SELECT 'session' AS kind, 'entry ' || k AS text, 'a, b' AS more FROM range(3, 12) t(k) UNION ALL SELECT 'session', 'PLAN: next', ''
UNION ALL SELECT 'change', 'change ' || k, 'x.py' FROM range(2, 22) t(k) UNION ALL SELECT 'change', 'one', 'y.py'
UNION ALL SELECT 'danger', substr(sha256('*never'), 1, 12), 'model' UNION ALL SELECT 'decision', substr(sha256('x.pyuse parquet'), 1, 12), 'columns'
""")
def tool_logs(spark, d):
    """Logs are capped, repeated entries are known, a removed one is gone."""
    tools = tool_store(spark, d, "tool-logs")
    for k in range(12):
        tools.call("log_session", entry=f"entry {k}", files_touched=["a", "b"])
    tools.call("plan", plan="next")
    for k in range(22):
        tools.call("log_change", file="x.py", summary=f"change {k}")
    tools.call("log_change", file="y.py", summary="one")
    for text in ("never", "never", "always"):
        tools.call("add_danger", description=text)
    gone = tools.store.read("dangers").filter("description = 'always'").first().id
    tools.call("remove_danger", id=gone)
    tools.call("add_decision", decision="use parquet", reason="columns", scope="x.py")
    rows = [
        tools.store.read("session_log").select(F.lit("session").alias("kind"), F.col("entry").alias("text"), F.coalesce("files_touched", F.lit("")).alias("more")),
        tools.store.read("changes").select(F.lit("change").alias("kind"), F.col("summary").alias("text"), F.col("file").alias("more")),
        tools.store.read("dangers").select(F.lit("danger").alias("kind"), F.col("id").alias("text"), F.col("added_by").alias("more")),
        tools.store.read("decisions").select(F.lit("decision").alias("kind"), F.col("id").alias("text"), F.col("reason").alias("more")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""
SELECT 'search' AS tool, '1. n/04.py — paper, paper' || chr(10) || '2. n/03.py — paper and some ink' AS text
UNION ALL SELECT 'one', '1. n/03.py — paper and some ink'
UNION ALL SELECT 'function', '1. n/05.py::' || (SELECT replace(lower(n_name), ' ', '_') FROM nation WHERE n_nationkey = 5) || ' — folds the letters'
UNION ALL SELECT 'none', 'Nothing found for ''zebra''.'
""")
def tool_search(spark, d):
    """The kept full-text index follows the files; functions by substring."""
    tools = tool_store(spark, d, "tool-search")
    tools.call("update_file", file="n/03.py", purpose="paper and some ink")
    tools.call("update_file", file="n/04.py", purpose="paper, paper")
    name = tools.store.read("functions").filter("file = 'n/05.py'").first().id
    tools.call("update_summary", type="function", id=name, summary="folds the letters")
    rows = [("search", "paper"), ("one", "ink paper"), ("function", "the letters"), ("none", "zebra")]
    return spark.createDataFrame([(k, tools.call("search", query=q)) for k, q in rows], "tool string, text string")


@query("""
WITH m AS (SELECT n_nationkey AS k, n_regionkey AS r, replace(lower(n_name), ' ', '_') AS name FROM nation), o AS (SELECT r_regionkey AS r, replace(lower(r_name), ' ', '_') AS name FROM region),
t AS (SELECT m.k, 'n/' || printf('%02d', m.k) || '.py' AS path, m.name, 'r' || m.r || '.py' AS home, o.name AS callee FROM m JOIN o ON o.r = m.r)
SELECT path, unnest(['## ' || path || ' [STALE]', '- def ' || name || '()  (lines 1-2) [STALE]', '## ' || home || ' [STALE]', '- ' || home || '::' || callee]) AS line FROM t WHERE k < 3
""")
def context_lines(spark, d):
    """Of the context of some files the lines on the file, its function, what it
    imports and what it calls."""
    tools = tool_store(spark, d, "context")
    rows = []
    for k in range(3):
        path = f"n/{k:02d}.py"
        lines = context.assemble(tools.store, path).split("\n")
        rows += [(path, x) for x in lines if x.startswith(("## ", "- "))]
    return spark.createDataFrame(rows, "path string, line string")
