from quarrylight.operators import calls, graph, imports


def statement(module, names=(), level=0, alias=None):
    return (module, list(names), level, alias)


def test_imports_of_four_languages(spark):
    s = statement
    rows = [
        ("pkg/a.py", "python", [], [s("pkg.b", ["FuncB"]), s("sub", [], 1), s("os")]),
        ("pkg/b.py", "python", ["FuncB"], []),
        ("pkg/sub/__init__.py", "python", [], []),
        ("pkg/__init__.py", "python", [], []),
        ("root.py", "python", [], [s("", ["pkg"], 1)]),
        ("src/utils.ts", "typescript", [], []),
        ("src/components/Button.tsx", "tsx", [], [s("../utils"), s("react")]),
        ("main.go", "go", [], [s("github.com/u/proj/db"), s("github.com/u/proj2/db"), s("fmt")]),
        ("db/db.go", "go", [], []),
        ("db/helper.go", "go", [], []),
        ("src/lib.rs", "rust", ["lib_func"], []),
        ("src/utils.rs", "rust", ["util_func"], []),
        ("src/utils/helper.rs", "rust", [], [s("crate::utils", ["util_func"]), s("std::io", ["Read"])]),
        ("src/sub/mod.rs", "rust", [], [s("super::utils", ["util_func"]), s("super::lib_func")]),
    ]
    files = spark.createDataFrame(rows, "path string, language string, exports array<string>, imports_raw array<struct<module:string,names:array<string>,level:int,alias:string>>")
    got = {}
    for r in imports.resolve(files, "github.com/u/proj").collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert got == {
        "pkg/a.py": {"pkg/b.py", "pkg/sub/__init__.py"},
        "root.py": {"pkg/__init__.py"},
        "src/components/Button.tsx": {"src/utils.ts"},
        "main.go": {"db/db.go", "db/helper.go"},
        "src/utils/helper.rs": {"src/utils.rs"},
        "src/sub/mod.rs": {"src/utils.rs", "src/lib.rs"},
    }
    back = {r.path: r.used_by for r in imports.with_imports(files, imports.resolve(files)).collect()}
    assert back["pkg/b.py"] == ["pkg/a.py"] and back["root.py"] == []


def test_call_rules(spark):
    fn = lambda file, cls, name, *c: (f"{file}::{cls + '.' if cls else ''}{name}", file, cls, name, [tuple(x) for x in c])
    functions = spark.createDataFrame(
        [
            fn("m.py", "Client", "start", ("execute", "self"), ("stop", "self")),
            fn("m.py", "Client", "execute", ("helper", None)),
            fn("m.py", "Manager", "execute"),
            fn("m.py", "Base", "stop"),
            fn("m.py", None, "helper", ("run", "other_module"), ("nowhere", None)),
            fn("m.py", None, "duck", ("execute", "obj"), ("only", "obj"), ("make", "Manager"), ("execute", "Manager")),
            fn("other.py", None, "run"),
            fn("other.py", "Deep", "only"),
            fn("other.py", "Manager", "make"),
        ],
        "id string, file string, class_name string, name string, calls array<struct<name:string,object:string>>",
    )
    raw = spark.createDataFrame([("m.py", "other", ["run"], "other_module")], "path string, module string, names array<string>, alias string")
    edges = spark.createDataFrame([("m.py", "other.py")], "src string, dst string")
    exports = spark.createDataFrame([("other.py", "run")], "file string, name string")
    supers = spark.createDataFrame([("m.py", "Client", "Mid"), ("m.py", "Mid", "Base"), ("m.py", "Base", "Client")], "file string, class_name string, super string")
    got = {(r.caller_id.split("::")[1], r.callee_name, r.pos): r for r in calls.resolve(functions, raw, edges, exports, supers).collect()}
    target = lambda *k: got[k].callee_id
    assert target("Client.start", "execute", 0) == "m.py::Client.execute"
    assert target("Client.start", "stop", 1) == "m.py::Base.stop"
    assert target("Client.execute", "helper", 0) == "m.py::helper"
    assert target("helper", "run", 0) == "other.py::run"
    assert target("helper", "nowhere", 1) is None and not got["helper", "nowhere", 1].is_ambiguous
    assert got["duck", "execute", 0].is_ambiguous and got["duck", "execute", 0].candidates == ["m.py::Client.execute", "m.py::Manager.execute"]
    assert target("duck", "only", 1) == "other.py::Deep.only"
    assert target("duck", "make", 2) == "other.py::Manager.make"
    assert target("duck", "execute", 3) == "m.py::Manager.execute"
    assert len(got) == 9


def test_chains_of_any_length(spark):
    steps = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (5, None), (3, 3)]
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestor_closure(spark.createDataFrame(steps, "a long, b long"), "a", "b").collect()}
    assert got == {(i, j): j - i for i in range(13) for j in range(i + 1, 13)} | {(20, 21): 1, (21, 20): 1}
    supers = spark.createDataFrame([("m.py", f"C{i}", f"C{i + 1}") for i in range(11)], "file string, class_name string, super string")
    functions = spark.createDataFrame([("m.py::C0.go", "m.py", "C0", "go", [("end", "self")]), ("m.py::C11.end", "m.py", "C11", "end", [])], "id string, file string, class_name string, name string, calls array<struct<name:string,object:string>>")
    none = lambda schema: spark.createDataFrame([], schema)
    out = calls.resolve(functions, none("path string, module string, names array<string>, alias string"), none("src string, dst string"), none("file string, name string"), supers).collect()
    assert [r.callee_id for r in out] == ["m.py::C11.end"]
