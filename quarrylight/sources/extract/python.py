"""Python files, by the standard library's parser."""

from __future__ import annotations

import ast

CLASS_DEPTH = 2
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def extract(text: str, hashes: bool = True, bodies: bool = True) -> dict:
    """The fields of a file's row; without ``hashes`` no tokens to hash, without
    ``bodies`` no functions."""
    tree = ast.parse(text)
    lines = text.splitlines(keepends=True)
    functions: list[dict] = []
    supers: list[dict] = []

    def members(body, owner: tuple[str, ...]):
        for node in body:
            if isinstance(node, DEFS):
                if bodies:
                    functions.append(function(node, ".".join(owner) or None, lines, hashes))
            elif isinstance(node, ast.ClassDef):
                path = (*owner, node.name)
                base = next((dotted(b) for b in node.bases if dotted(b)), None)
                if base:
                    supers.append({"class_name": ".".join(path), "super": base})
                if len(path) <= CLASS_DEPTH:
                    members(node.body, path)
            elif not owner:
                for inner in blocks(node):
                    members(inner, owner)

    members(tree.body, ())
    return {"exports": exports(tree), "imports_raw": imports(tree), "supers": supers, "functions": functions, "tokens": canonical(tree) if hashes else None}


def blocks(node) -> list[list]:
    """The statement lists of a top-level if or try."""
    if isinstance(node, ast.If):
        return [node.body, node.orelse]
    if isinstance(node, (ast.Try, ast.TryStar)):
        return [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody]
    return []


def dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else None
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    return None


def function(node, class_name: str | None, lines: list[str], hashes: bool = True) -> dict:
    return {
        "name": node.name,
        "class_name": class_name,
        "signature": signature(node, lines),
        "line_start": node.lineno,
        "line_end": node.end_lineno,
        "mutates": mutations(node),
        "calls": calls(node),
        "tokens": canonical(node) if hashes else None,
    }


def signature(node, lines: list[str]) -> str:
    """The source of the header, without its colon."""
    head = lines[node.lineno - 1].encode()[node.col_offset :].decode() + "".join(lines[node.lineno : node.body[0].lineno])
    depth, quote, i = 0, "", 0
    while i < len(head):
        c = head[i]
        if quote:
            if c == "\\":
                i += 1
            elif head.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if head.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            while i < len(head) and head[i] != "\n":
                i += 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and not depth:
            return head[:i].strip()
        i += 1
    return head.strip()


def mutations(node) -> list[str]:
    """Attributes of self or cls that are assigned, and rebound outer names."""
    found = set()

    def target(t):
        if isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                target(x)
        elif isinstance(t, ast.Starred):
            target(t.value)
        elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id in ("self", "cls"):
            found.add(f"{t.value.id}.{t.attr}")

    for x in ast.walk(node):
        if isinstance(x, ast.Assign):
            for t in x.targets:
                target(t)
        elif isinstance(x, ast.AnnAssign):
            target(x.target)
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            found.update(f"global:{n}" for n in x.names)
    return sorted(found)


def calls(node) -> list[dict]:
    """All call sites in source order, nested ones included."""
    found = []
    outside = {id(x) for d in node.decorator_list for x in ast.walk(d)}
    for x in ast.walk(node):
        if isinstance(x, ast.Call) and id(x) not in outside:
            f = x.func
            if isinstance(f, ast.Name):
                found.append((x.lineno, x.col_offset, x.end_col_offset, f.id, None))
            elif isinstance(f, ast.Attribute):
                found.append((x.lineno, x.col_offset, x.end_col_offset, f.attr, ast.unparse(f.value)))
    return [{"name": n, "object": o} for *_, n, o in sorted(found, key=lambda c: c[:3])]


def imports(tree) -> list[dict]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, {"module": a.name, "names": [], "level": 0, "alias": a.asname}) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            aliases = [a.asname for a in node.names if a.asname]
            out.append((node.lineno, {"module": node.module or "", "names": [a.name for a in node.names], "level": node.level, "alias": aliases[-1] if aliases else None}))
    return [x for _, x in sorted(out, key=lambda p: p[0])]


def exports(tree) -> list[str]:
    """__all__ where it is a list of strings, else public top-level names."""
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            return [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    names = []

    def visit(body):
        for node in body:
            if isinstance(node, (*DEFS, ast.ClassDef)):
                names.append(node.name)
            for inner in blocks(node):
                visit(inner)

    visit(tree.body)
    return list(dict.fromkeys(n for n in names if not n.startswith("_")))


def canonical(node) -> list[str]:
    """A form that comments, layout, quotes and docstrings do not change."""
    hidden = []
    for x in ast.walk(node):
        if isinstance(x, (*DEFS, ast.ClassDef, ast.Module)) and x.body and isinstance(x.body[0], ast.Expr) and isinstance(x.body[0].value, ast.Constant) and isinstance(x.body[0].value.value, str):
            hidden.append((x, x.body))
            x.body = x.body[1:]
    try:
        return [ast.dump(node, annotate_fields=False)]
    finally:
        for x, body in hidden:
            x.body = body
