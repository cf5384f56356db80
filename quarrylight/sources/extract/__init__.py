"""File bytes -> functions, imports, exports, calls and hashes.

``extract`` parses whole files on the executors; everything after it is
relational. A file that cannot be parsed gives a row with ``error`` set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.extract import braces, python

#: Extensions and their languages. The files that are indexed.
EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
}
EXTRACTORS: dict[str, Callable[[str], dict]] = {
    "python": python.extract,
    "javascript": braces.extract_js,
    "typescript": braces.extract_js,
    "tsx": braces.extract_js,
    "go": braces.extract_go,
    "rust": braces.extract_rust,
}

#: Extractors that can leave out what is not wanted.
PRUNABLE = (python.extract, braces.extract_js, braces.extract_go, braces.extract_rust)

CALL = pa.struct([("name", pa.string()), ("object", pa.string())])
FUNCTION = pa.struct([("name", pa.string()), ("class_name", pa.string()), ("signature", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("mutates", pa.list_(pa.string())), ("semantic_hash", pa.string()), ("calls", pa.list_(CALL))])
IMPORT = pa.struct([("module", pa.string()), ("names", pa.list_(pa.string())), ("level", pa.int32()), ("alias", pa.string())])
SUPER = pa.struct([("class_name", pa.string()), ("super", pa.string())])
FIELDS = [("path", pa.string()), ("language", pa.string()), ("content_hash", pa.string()), ("semantic_hash", pa.string()), ("n_lines", pa.int32()), ("exports", pa.list_(pa.string())), ("imports_raw", pa.list_(IMPORT)), ("supers", pa.list_(SUPER)), ("functions", pa.list_(FUNCTION)), ("error", pa.string())]
SCHEMA = (
    "path string, language string, content_hash string, semantic_hash string, n_lines int, exports array<string>, "
    "imports_raw array<struct<module:string,names:array<string>,level:int,alias:string>>, supers array<struct<class_name:string,super:string>>, "
    "functions array<struct<name:string,class_name:string,signature:string,line_start:int,line_end:int,mutates:array<string>,semantic_hash:string,calls:array<struct<name:string,object:string>>>>, error string"
)


def register_language(name: str, extensions: list[str], extractor: Callable[[str], dict]) -> None:
    """Adds a language: the extractor maps a text to the fields of a row."""
    EXTRACTORS[name] = extractor
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name[name.rfind(".") :]) if "." in name[1:] else None


def pruned(hashes: bool, functions: bool) -> dict[str, Callable[[str], dict]]:
    """The extractors without hashes of tokens, or without functions, where they
    can do without."""
    return {k: partial(f, hashes=hashes, bodies=functions) if f in PRUNABLE else f for k, f in EXTRACTORS.items()}


def token_hash(tokens: list[str] | None) -> str | None:
    return None if tokens is None else hashlib.sha256(" ".join(tokens).encode("utf-8", "surrogatepass")).hexdigest()


def extract_one(path: str, language: str | None, content: bytes | None, extractors=None) -> dict:
    """One row; never raises."""
    content = content or b""
    row = {"path": path, "language": language, "content_hash": hashlib.sha256(content).hexdigest(), "semantic_hash": None, "n_lines": content.count(b"\n") + 1, "exports": [], "imports_raw": [], "supers": [], "functions": [], "error": None}
    try:
        found = (extractors or EXTRACTORS)[language](content.decode("utf-8", "replace"))
    except KeyError:
        return row | {"error": f"no extractor for {language}"}
    except (SyntaxError, ValueError, RecursionError, IndexError) as problem:
        tokens = braces.rough_tokens(content.decode("utf-8", "replace"))
        return row | {"error": f"{type(problem).__name__}: {problem}"[:300], "semantic_hash": token_hash(tokens)}
    tokens = found.pop("tokens")
    for f in found["functions"]:
        f["semantic_hash"] = token_hash(f.pop("tokens"))
    return row | found | {"semantic_hash": token_hash(tokens), "exports": found["exports"]}


def extract(files: DataFrame, hashes: bool = True, functions: bool = True) -> DataFrame:
    """Rows of SCHEMA from files (path, content); files of no known language
    are left out before any content is read. Without ``hashes`` the semantic
    hashes are null, without ``functions`` there are none: most of the time goes
    into these. Files are read by as many tasks as hold them."""
    known, extractors = dict(EXTENSIONS), pruned(hashes, functions)
    ext = F.regexp_extract("path", r"[^/]+?(\.[^./]+)$", 1)
    language = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext)
    rows = files.filter(ext.isin(list(known))).select("path", language.alias("language"), "content")

    def run(batches):
        for batch in batches:
            out = [extract_one(p, l, c, extractors) for p, l, c in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(FIELDS))

    return rows.mapInArrow(run, SCHEMA)
