from quarrylight.sources.extract import extract_one, language_of


def pull(language, text, path="x"):
    row = extract_one(path, language, text.encode())
    assert row["error"] is None, row["error"]
    return row, {f"{f['class_name']}.{f['name']}" if f["class_name"] else f["name"]: f for f in row["functions"]}


PY = '''
import os, a.b as c
from ..m import x as y, z
class User(Base):
    class Inner:
        def deep(self):
            self.q = 1
    @deco(1)
    def go(self, a: int = 3, *, b="x:") -> dict[str, int]:
        """Says."""
        self.x, self.y = 1, 2
        self.n += 1
        global G
        G = 1
        return c.run(self.go())
async def f(): pass
def _hidden(): pass
if True:
    def g(): f()
'''


def test_python():
    row, f = pull("python", PY)
    assert row["exports"] == ["User", "f", "g"]
    assert [(i["module"], i["names"], i["level"], i["alias"]) for i in row["imports_raw"]] == [("os", [], 0, None), ("a.b", [], 0, "c"), ("m", ["x", "z"], 2, "y")]
    assert set(f) == {"User.Inner.deep", "User.go", "f", "_hidden", "g"}
    assert f["User.go"]["signature"] == 'def go(self, a: int = 3, *, b="x:") -> dict[str, int]'
    assert f["User.go"]["mutates"] == ["global:G", "self.x", "self.y"]
    assert [(c["object"], c["name"]) for c in f["User.go"]["calls"]] == [("c", "run"), ("self", "go")]
    assert row["supers"] == [{"class_name": "User", "super": "Base"}]
    assert pull("python", "__all__ = ['p']\ndef q(): pass")[0]["exports"] == ["p"]


def test_semantic_hash_is_an_equivalence():
    base = 'def f(a):\n    """Doc."""\n    return a + "x"\n'
    same = ["# c\ndef f( a ):\n\n    return a + 'x'  # d\n", 'def f(a):\n    """Other."""\n    return (a + "x")\n']
    other = ['def f(a):\n    return a - "x"\n', 'def g(a):\n    return a + "x"\n']
    h = extract_one("x", "python", base.encode())["semantic_hash"]
    assert all(extract_one("x", "python", s.encode())["semantic_hash"] == h for s in same)
    assert all(extract_one("x", "python", s.encode())["semantic_hash"] != h for s in other)
    js = "function f(a) { return a + 'x'; }"
    k = extract_one("x", "javascript", js.encode())["semantic_hash"]
    assert extract_one("x", "javascript", b'// c\nfunction f(a) {\n  return a + "x"; /* d */ }')["semantic_hash"] == k
    assert extract_one("x", "javascript", b"function f(a) { return a * 'x'; }")["semantic_hash"] != k


def test_javascript():
    row, f = pull("javascript", """
import Main, { one, two as deux } from "./lib";
import * as ns from '../ns';
export class Panel extends Base {
  constructor(title) { this.title = title; this.open = false; }
  toggle() { this.open = !this.open; helper(this.title); ns.run(`a${"}"}b`); }
}
export function helper(a, b = {c: 1}) { return /a{2}/.test(a) ? one() : 2; }
const arrow = (x) => { return x * 2; };
export default arrow;
""")
    assert set(row["exports"]) == {"Panel", "helper", "default"}
    assert row["imports_raw"][0] | {} == {"module": "./lib", "names": ["Main", "one", "two"], "level": 0, "alias": "deux"}
    assert row["imports_raw"][1]["names"] == ["*"] and row["imports_raw"][1]["alias"] == "ns"
    assert f["Panel.constructor"]["signature"] == "constructor(title)"
    assert f["Panel.constructor"]["mutates"] == ["this.open", "this.title"]
    assert [(c["object"], c["name"]) for c in f["Panel.toggle"]["calls"]] == [(None, "helper"), ("ns", "run")]
    assert f["helper"]["signature"] == "function helper(a, b = {c: 1})" and f["arrow"]["signature"] == "(x) =>"


def test_typescript():
    row, f = pull("typescript", """
interface P { a: string }
export type T = { b: number };
export class S<T> { private n: number = 0; async get<U>(k: string): Promise<U> { this.n = 1; return this.fetch<U>(k); } on = (e: Event): void => { this.n = 2; } }
export const make = (n: string): S<number> => { return build(n); };
function g(x: number): { a: string } { return { a: String(x) }; }
""")
    assert set(row["exports"]) == {"S", "make"}
    assert f["S.get"]["mutates"] == ["this.n"] and f["make"]["calls"] == [{"name": "build", "object": None}]
    assert f["g"]["signature"] == "function g(x: number): { a: string }"


def test_go():
    row, f = pull("go", """
package main
import (
    "fmt"
    lg "github.com/a/b"
)
type Conf struct { Host string }
var Pub = "x"
const small = 2
func New(h string, p int) *Conf { return &Conf{Host: h} }
func (c *Conf) Set(h string) (int, error) { c.Host = h; fmt.Println(h); return 1, nil }
func helper() {}
""")
    assert row["exports"] == ["Conf", "New", "Pub"]
    assert [(i["module"], i["alias"]) for i in row["imports_raw"]] == [("fmt", None), ("github.com/a/b", "lg")]
    assert f["Conf.Set"]["signature"] == "func (c *Conf) Set(h string) (int, error)" and f["Conf.Set"]["mutates"] == ["c.Host"]
    assert f["New"]["signature"] == "func New(h string, p int) *Conf"


def test_rust():
    row, f = pull("rust", """
use std::collections::HashMap;
use crate::utils::{self, helper};
pub struct Db<T> { name: String }
impl<T> Db<T> {
    pub fn new() -> Self { Db { name: String::new() } }
    pub fn set<'a>(&'a mut self, n: String) { self.name = n; self.touch(); }
}
impl<T> Trait for Db<T> where T: X { fn touch(&self) {} }
pub fn run_app() { let c = '}'; println!("{}", c); let d = Db::new(); }
fn internal() {}
""")
    assert row["exports"] == ["Db", "run_app"]
    assert [(i["module"], i["names"]) for i in row["imports_raw"]] == [("std::collections", ["HashMap"]), ("crate::utils", ["self"]), ("crate::utils", ["helper"])]
    assert f["Db.set"]["mutates"] == ["self.name"] and f["Db.touch"]["class_name"] == "Db"
    assert f["run_app"]["calls"] == [{"name": "new", "object": "Db"}]


def test_broken_and_unknown_files():
    bad = extract_one("x.py", "python", b"def (:")
    assert bad["error"] and bad["functions"] == [] and bad["semantic_hash"]
    assert extract_one("x.py", "python", None)["error"] is None
    for language in ("javascript", "go", "rust"):
        assert extract_one("x", language, b"}}} ((( func fn class export {")["path"] == "x"
    assert extract_one("x", "cobol", b"")["error"]
    assert language_of("a/b.tsx") == "tsx" and language_of("a/.py") is None and language_of("Makefile") is None
