"""JavaScript, TypeScript, Go and Rust, by a tolerant scanner.

One lexer gives tokens without comments; brackets are paired once; each
language then reads declarations off the token stream. Nothing here needs a
grammar, and unknown constructs are stepped over.
"""

from __future__ import annotations

import re
from typing import NamedTuple

PUNCT = re.compile(r"=>|->|::|:=|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[+\-*/%&|^]=|.", re.S)
WORD = re.compile(r"[#@$\w]+(?:(?<=\d)\.\d+)?")
SPACE = re.compile(r"\s+")
RUST_RAW, RUST_CHAR = re.compile(r'b?r(#*)"'), re.compile(r"'(\\.[^']*|[^\\'])'")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words after which a slash starts a pattern in JavaScript.
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "super", "match", "loop", "in", "typeof", "await", "go", "defer", "yield", "import", "else", "select", "range", "async", "let", "const", "var", "mut", "as", "where", "impl", "dyn"}


class Token(NamedTuple):
    text: str
    kind: str  # word, str or punct
    start: int
    end: int


def lex(src: str, language: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(src)
    while i < n:
        c = src[i]
        if c.isspace():
            i = SPACE.match(src, i).end()
        elif src.startswith("//", i):
            i = src.find("\n", i)
            i = n if i < 0 else i
        elif src.startswith("/*", i):
            i = block_comment(src, i, language == "rust")
        elif c == "`" and language != "rust":
            end = template(src, i) if language == "js" else raw_end(src, i, "`")
            out.append(Token(src[i + 1 : end - 1], "str", i, end))
            i = end
        elif language == "rust" and (m := RUST_RAW.match(src, i)):
            end = raw_end(src, m.end() - 1, '"' + m[1])
            out.append(Token(src[m.end() : end - 1 - len(m[1])], "str", i, end))
            i = end
        elif c == "'" and language == "rust" and not RUST_CHAR.match(src, i):
            end = WORD.match(src, i + 1).end() if WORD.match(src, i + 1) else i + 1
            out.append(Token(src[i:end], "word", i, end))  # a lifetime
            i = end
        elif c in "\"'":
            end = quoted(src, i)
            out.append(Token(src[i + 1 : end - 1], "str", i, end))
            i = end
        elif c == "/" and language == "js" and (not out or out[-1].kind == "punct" and out[-1].text not in (")", "]", "}") or out[-1].text in BEFORE_PATTERN):
            end = pattern(src, i)
            out.append(Token(src[i:end], "str", i, end))
            i = end
        elif m := WORD.match(src, i):
            out.append(Token(m[0], "word", i, m.end()))
            i = m.end()
        else:
            m = PUNCT.match(src, i)
            out.append(Token(m[0], "punct", i, m.end()))
            i = m.end()
    return out


def rough_tokens(text: str) -> list[str]:
    """Words and marks of a text that no extractor could read."""
    return re.findall(r"\w+|[^\w\s]", text)


def block_comment(src: str, i: int, nested: bool) -> int:
    depth, i = 1, i + 2
    while i < len(src) and depth:
        if src.startswith("*/", i):
            depth, i = depth - 1, i + 2
        elif nested and src.startswith("/*", i):
            depth, i = depth + 1, i + 2
        else:
            i += 1
    return i


def quoted(src: str, i: int) -> int:
    q, j = src[i], i + 1
    while j < len(src) and src[j] != q:
        if src[j] == "\n" and q == "'":
            break
        j += 2 if src[j] == "\\" else 1
    return min(len(src), j + 1)


def raw_end(src: str, i: int, mark: str) -> int:
    j = src.find(mark, i + 1)
    return len(src) if j < 0 else j + len(mark)


def template(src: str, i: int) -> int:
    j = i + 1
    while j < len(src) and src[j] != "`":
        if src[j] == "\\":
            j += 2
        elif src.startswith("${", j):
            depth, j = 1, j + 2
            while j < len(src) and depth:
                if src[j] == "`":
                    j = template(src, j)
                    continue
                depth += {"{": 1, "}": -1}.get(src[j], 0)
                j += 1
        else:
            j += 1
    return min(len(src), j + 1)


def pattern(src: str, i: int) -> int:
    j, group = i + 1, False
    while j < len(src) and src[j] != "\n":
        if src[j] == "\\":
            j += 1
        elif src[j] == "[":
            group = True
        elif src[j] == "]":
            group = False
        elif src[j] == "/" and not group:
            break
        j += 1
    j += 1
    while j < len(src) and src[j].isalpha():
        j += 1
    return min(len(src), j)


class Source:
    """Tokens, paired brackets and line numbers of one file; without ``hashes`` no
    tokens to hash, without ``bodies`` no functions."""

    def __init__(self, text: str, language: str, hashes: bool = True, bodies: bool = True):
        self.text, self.t, self.hashes, self.bodies = text, lex(text, language), hashes, bodies
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, tok in enumerate(self.t):
            if tok.kind != "punct":
                continue
            if tok.text in OPEN:
                stack.append(k)
            elif tok.text in CLOSE and stack:
                if self.t[stack[-1]].text == CLOSE[tok.text]:
                    self.pair[stack.pop()] = k
                elif any(self.t[s].text == CLOSE[tok.text] for s in stack):
                    while self.t[stack[-1]].text != CLOSE[tok.text]:
                        stack.pop()
                    self.pair[stack.pop()] = k
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) and self.t[k].kind != "str" else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "word"

    def line(self, offset: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, offset) + 1

    def skip(self, k: int) -> int:
        """The token after the one at k, brackets as a whole."""
        return self.pair.get(k, k) + 1

    def angle(self, k: int) -> int:
        """The token after a <...> group that starts at k."""
        depth, j = 0, k
        while j < len(self.t):
            x = self.at(j)
            depth += (x == "<") - (x == ">")
            if depth == 0:
                return j + 1
            if x in (";", "{"):
                return k
            j += 1
        return k

    def tokens(self, a: int, z: int) -> list[str] | None:
        """Tokens for a hash: strings without their quotes' style."""
        return None if not self.hashes else [f'"{t.text}"' if t.kind == "str" else t.text for t in self.t[a:z]]

    def calls(self, a: int, z: int) -> list[dict]:
        """Words followed by an argument list; what stands before a dot or a
        double colon is the object."""
        out = []
        for k in range(a, z):
            if not self.word(k) or self.t[k].text in NOT_CALLED or self.t[k].text[0].isdigit():
                continue
            j = k + 1
            if self.at(j) == "::" and self.at(j + 1) == "<":
                j = self.angle(j + 1)
            if self.at(j) != "(" or self.at(k - 1) in ("function", "func", "fn", "new"):
                continue
            first = k
            while self.at(first - 1) in (".", "?.", "::") and (self.word(first - 2) or self.at(first - 2) in (")", "]")):
                if self.word(first - 2):
                    first -= 2
                else:
                    opener = next((o for o, c in self.pair.items() if c == first - 2), None)
                    if opener is None:
                        break
                    first = opener - 1 if self.word(opener - 1) else opener
            if self.at(first - 1) == "new":
                continue
            out.append({"name": self.t[k].text, "object": self.text[self.t[first].start : self.t[k - 2].end] if first < k else None})
        return out

    def assigned(self, a: int, z: int, owner: str) -> list[str]:
        """owner.field before a plain assignment."""
        return sorted({f"{owner}.{self.t[k + 2].text}" for k in range(a, z - 3) if self.at(k) == owner and self.at(k - 1) != "." and self.at(k + 1) == "." and self.word(k + 2) and self.at(k + 3) == "="})

    def function(self, name: str, owner: str | None, start: int, body: int, mutates: list[str]) -> dict:
        """A function whose header starts at token start and whose body opens
        at token body (or is an expression up to the line's end)."""
        if not self.bodies:
            return {}
        end = self.pair.get(body, body) if self.at(body) == "{" else self.expression_end(body)
        head = self.text[self.t[start].start : self.t[body].start].strip()
        return {
            "name": name,
            "class_name": owner,
            "signature": head.rstrip("{").strip(),
            "line_start": self.line(self.t[start].start),
            "line_end": self.line(self.t[min(end, len(self.t) - 1)].start),
            "mutates": mutates,
            "calls": self.calls(body, end + 1),
            "tokens": self.tokens(start, end + 1),
        }

    def expression_end(self, k: int) -> int:
        j = k
        while j < len(self.t):
            if self.at(j) in (";", ",", ")", "]", "}"):
                return j - 1
            nxt = self.skip(j)
            if nxt < len(self.t) and self.line(self.t[nxt - 1].start) != self.line(self.t[nxt].start) and self.t[nxt].kind == "word":
                return nxt - 1
            j = nxt
        return len(self.t) - 1


# --- JavaScript and TypeScript -----------------------------------------------


def js_body(s: Source, params: int) -> int | None:
    """The token that opens the body after a parameter list at params."""
    j = s.pair.get(params)
    if j is None:
        return None
    j += 1
    if s.at(j) == ":":
        j += 1
        while j < len(s.t):
            if s.at(j) == "{" and s.at(j - 1) not in (":", "|", "&", "=>", "<", ","):
                break
            if s.at(j) in (";", "=>") or s.at(j) in CLOSE:
                break
            j = s.skip(j)
    return j if s.at(j) == "{" else None


def js_value(s: Source, k: int) -> tuple[int, int] | None:
    """(start, body) of a function value at token k: function or arrow."""
    j = k + 1 if s.at(k) == "async" else k
    if s.at(j) == "function":
        p = j + 1
        while p < len(s.t) and s.at(p) != "(":
            p += 1
        body = js_body(s, p)
        return (k, body) if body else None
    if s.at(j) == "<":
        j = s.angle(j)
    if s.at(j) == "(" and j in s.pair:
        e = s.pair[j] + 1
        if s.at(e) == ":":
            while e < len(s.t) and s.at(e) not in ("=>", ";", "{") and s.at(e) not in CLOSE:
                e = s.skip(e)
        return (k, e + 1) if s.at(e) == "=>" and e + 1 < len(s.t) else None
    if s.word(j) and s.at(j + 1) == "=>" and j + 2 < len(s.t):
        return (k, j + 2)
    return None


def extract_js(text: str, hashes: bool = True, bodies: bool = True) -> dict:
    s = Source(text, "js", hashes, bodies)
    out: dict = {"exports": [], "imports_raw": [], "supers": [], "functions": [], "tokens": s.tokens(0, len(s.t))}
    exported: set[str] = set()
    k = 0
    while k < len(s.t):
        start, public = k, False
        if s.at(k) == "export":
            public, k = True, k + 1
            if s.at(k) == "default":
                exported.add("default")
                public, k = False, k + 1
            if s.at(k) == "{":
                end = s.pair.get(k, k)
                exported.update(s.t[j].text for j in range(k + 1, end) if s.word(j) and s.at(j - 1) in ("{", ",") and s.at(j) != "type")
                k = end + 1
                continue
        while s.at(k) in ("declare", "abstract", "async") and s.word(k + 1):
            k += 1
        word = s.at(k)
        if word == "import" and s.at(k + 1) not in ("(", "."):
            k = js_import(s, k, out)
        elif word == "function":
            p = k + 1
            while p < len(s.t) and s.at(p) not in ("(", ";"):
                p += 1
            name = next((s.t[j].text for j in range(k + 1, p) if s.word(j)), None)
            body = js_body(s, p)
            if name and public:
                exported.add(name)
            if name and body:
                first = start + 1 if public else k - (s.at(k - 1) == "async")
                out["functions"].append(s.function(name, None, first, body, s.assigned(body, s.pair.get(body, body), "this")))
            k = s.pair.get(body, body) + 1 if body else p + 1
        elif word == "class" and s.word(k + 1):
            if public:
                exported.add(s.t[k + 1].text)
            k = js_class(s, k, out)
        elif word in ("const", "let", "var"):
            k = js_variables(s, k, public, exported, out)
        elif word == "enum" and public and s.word(k + 1):
            exported.add(s.t[k + 1].text)
            k += 2
        else:
            k = max(s.skip(k), start + 1)
    out["exports"] = sorted(exported)
    return out if bodies else out | {"functions": []}


def js_import(s: Source, k: int, out: dict) -> int:
    j, names, alias = k + 1, [], None
    while j < len(s.t) and s.t[j].kind != "str":
        x = s.t[j].text
        if x == ";" or x == "=":
            return j + 1
        if x == "*":
            names.append("*")
        elif s.word(j) and x == "as":
            alias, j = s.t[j + 1].text, j + 1
        elif s.word(j) and x not in ("from", "type"):
            names.append(x)
        j += 1
    if j < len(s.t):
        out["imports_raw"].append({"module": s.t[j].text, "names": names, "level": 0, "alias": alias})
    return j + 1


def js_class(s: Source, k: int, out: dict) -> int:
    name, j = s.t[k + 1].text, k + 2
    while j < len(s.t) and s.at(j) != "{":
        if s.at(j) == "extends" and s.word(j + 1):
            out["supers"].append({"class_name": name, "super": s.t[j + 1].text})
        j += 1
    end = s.pair.get(j, len(s.t) - 1)
    j += 1
    while j < end:
        start = j
        while s.at(j) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*") and s.at(j + 1) not in ("(", "<", "=", ";", ":"):
            j += 1
        if s.word(j):
            p = s.angle(j + 1) if s.at(j + 1) == "<" else j + 1
            if s.at(p) == "(":
                body = js_body(s, p)
                if body:
                    out["functions"].append(s.function(s.t[j].text, name, start, body, s.assigned(body, s.pair.get(body, body), "this")))
                    j = s.pair.get(body, body) + 1
                    continue
            else:
                e = p
                while e < end and s.at(e) not in ("=", ";", "}") and s.line(s.t[e].start) == s.line(s.t[j].start):
                    e = s.skip(e)
                value = js_value(s, e + 1) if s.at(e) == "=" else None
                if value:
                    f = s.function(s.t[j].text, name, *value, s.assigned(value[1], s.pair.get(value[1], value[1]), "this"))
                    out["functions"].append(f)
                    j = s.pair.get(value[1], value[1]) + 1
                    continue
        j = max(s.skip(j), start + 1)
    return end + 1


def js_variables(s: Source, k: int, public: bool, exported: set, out: dict) -> int:
    j = k + 1
    while j < len(s.t):
        if not s.word(j):
            return s.skip(j)
        name = s.t[j].text
        if public:
            exported.add(name)
        e = j + 1
        while e < len(s.t) and s.at(e) not in ("=", ";", ",") and s.line(s.t[e].start) == s.line(s.t[j].start):
            e = s.skip(e)
        if s.at(e) == "=":
            value = js_value(s, e + 1)
            if value:
                f = s.function(name, None, *value, s.assigned(value[1], s.pair.get(value[1], value[1]), "this"))
                out["functions"].append(f)
                return s.pair.get(value[1], s.expression_end(value[1])) + 1
            e += 1
            while e < len(s.t) and s.at(e) not in (";", ","):
                nxt = s.skip(e)
                if nxt < len(s.t) and s.line(s.t[nxt - 1].start) != s.line(s.t[nxt].start) and s.t[nxt].kind == "word":
                    return nxt
                e = nxt
        if s.at(e) != ",":
            return max(e, j + 1)
        j = e + 1
    return j


# --- Go ------------------------------------------------------------------------


def extract_go(text: str, hashes: bool = True, bodies: bool = True) -> dict:
    s = Source(text, "go", hashes, bodies)
    out: dict = {"exports": [], "imports_raw": [], "supers": [], "functions": [], "tokens": s.tokens(0, len(s.t))}
    public: list[str] = []
    k = 0
    while k < len(s.t):
        word = s.at(k)
        if word == "import":
            end = s.pair.get(k + 1, k + 2)
            for j in range(k + 1, end + 1):
                if j < len(s.t) and s.t[j].kind == "str":
                    alias = s.t[j - 1].text if s.word(j - 1) and s.t[j - 1].text != "import" or s.at(j - 1) == "." else None
                    out["imports_raw"].append({"module": s.t[j].text, "names": [], "level": 0, "alias": alias})
            k = end + 1
        elif word == "func":
            k = go_function(s, k, out, public)
        elif word in ("type", "var", "const"):
            if s.at(k + 1) == "(":
                end, j, fresh = s.pair.get(k + 1, k + 1), k + 2, True
                while j < end:
                    if fresh and s.word(j):
                        public.append(s.t[j].text)
                    nxt = s.skip(j)
                    fresh = nxt < end and s.line(s.t[nxt - 1].start) != s.line(s.t[nxt].start) or s.at(j) == ","
                    j = nxt
                k = end + 1
            else:
                j = k + 1
                while s.word(j):
                    public.append(s.t[j].text)
                    if s.at(j + 1) != ",":
                        break
                    j += 2
                k = j + 1
        else:
            k = s.skip(k)
    out["exports"] = sorted({n for n in public if n[:1].isupper()})
    return out if bodies else out | {"functions": []}


def go_function(s: Source, k: int, out: dict, public: list[str]) -> int:
    j, owner, receiver = k + 1, None, None
    if s.at(j) == "(" and j in s.pair:
        inside = [s.t[i].text for i in range(j + 1, s.pair[j]) if s.word(i)]
        receiver, owner = (inside[0], inside[1]) if len(inside) > 1 else (None, inside[0] if inside else None)
        j = s.pair[j] + 1
    if not s.word(j):
        return k + 1
    name, j = s.t[j].text, j + 1
    if s.at(j) == "[":
        j = s.skip(j)
    if s.at(j) != "(" or j not in s.pair:
        return j
    j = s.pair[j] + 1
    if s.at(j) == "(":
        j = s.skip(j)
    else:
        while j < len(s.t) and s.at(j) != "{" and s.line(s.t[j].start) == s.line(s.t[j - 1].start):
            j = s.skip(j + 1) if s.at(j) in ("interface", "struct") and s.at(j + 1) == "{" else s.skip(j)
    if owner is None:
        public.append(name)
    if s.at(j) != "{":
        return j
    end = s.pair.get(j, j)
    out["functions"].append(s.function(name, owner, k, j, s.assigned(j, end, receiver) if receiver else []))
    return end + 1


# --- Rust ----------------------------------------------------------------------


def extract_rust(text: str, hashes: bool = True, bodies: bool = True) -> dict:
    s = Source(text, "rust", hashes, bodies)
    out: dict = {"exports": [], "imports_raw": [], "supers": [], "functions": [], "tokens": s.tokens(0, len(s.t))}
    public: list[str] = []
    rust_items(s, 0, len(s.t), None, out, public)
    out["exports"] = sorted(set(public))
    return out if bodies else out | {"functions": []}


def rust_items(s: Source, k: int, end: int, owner: str | None, out: dict, public: list[str]) -> None:
    while k < end:
        start, is_public = k, False
        if s.at(k) == "#" or s.at(k).startswith("#"):
            k = s.skip(k + 1) if s.at(k + 1) == "[" else k + 1
            continue
        if s.at(k) == "pub":
            is_public, k = True, k + 1
            if s.at(k) == "(":
                k = s.skip(k)
        while s.at(k) in ("async", "unsafe", "const", "extern", "default") and (s.at(k + 1) in ("fn", "async", "unsafe", "extern", "impl", "trait") or s.at(k) == "extern"):
            k += 1
            if k < end and s.t[k].kind == "str":
                k += 1
        word = s.at(k)
        if word == "fn" and s.word(k + 1):
            name, j = s.t[k + 1].text, k + 2
            if is_public and owner is None:
                public.append(name)
            while j < end and s.at(j) not in ("{", ";"):
                j = s.skip(j)
            if s.at(j) == "{":
                last = s.pair.get(j, end - 1)
                out["functions"].append(s.function(name, owner, start, j, s.assigned(j, last, "self") if owner else []))
                k = last + 1
            else:
                k = j + 1
        elif word == "impl":
            j, head = k + 1, []
            if s.at(j) == "<":
                j = s.angle(j)
            while j < end and s.at(j) not in ("{", ";", "where"):
                if s.at(j) == "<":
                    j = max(s.angle(j), j + 1)
                    continue
                head.append(s.at(j))
                j += 1
            if "for" in head:
                head = head[head.index("for") + 1 :]
            kind = next((w for w in reversed(head) if w and (w[0].isalpha() or w[0] == "_")), None)
            while j < end and s.at(j) not in ("{", ";"):
                j += 1
            last = s.pair.get(j, j)
            if s.at(j) == "{":
                rust_items(s, j + 1, last, kind, out, public)
            k = last + 1
        elif word == "use":
            j = k + 1
            while j < end and s.at(j) != ";":
                j += 1
            rust_use(s, k + 1, j, [], out)
            k = j + 1
        elif word in ("struct", "enum", "trait", "mod", "const", "static", "type", "union") and s.word(k + 1):
            name = k + 2 if s.at(k + 1) == "mut" else k + 1
            if is_public and owner is None:
                public.append(s.t[name].text)
            j = name + 1
            while j < end and s.at(j) not in ("{", ";"):
                j = s.skip(j)
            if word == "trait" and s.at(j) == "{":
                rust_items(s, j + 1, s.pair.get(j, j), s.t[name].text, out, public)
            k = s.pair.get(j, j) + 1
        else:
            k = max(s.skip(k), start + 1)


def rust_use(s: Source, a: int, z: int, lead: list[str], out: dict) -> None:
    """One statement an imported path; groups are taken apart."""
    path, j, alias = list(lead), a, None
    while j < z:
        x = s.at(j)
        if x == "{":
            close, part = s.pair.get(j, z), j + 1
            i = part
            while i <= close:
                if i == close or s.at(i) == ",":
                    if i > part:
                        rust_use(s, part, i, path, out)
                    part = i + 1
                i = s.skip(i) if s.at(i) == "{" else i + 1
            return
        if x == "as" and s.word(j + 1):
            alias, j = s.t[j + 1].text, j + 1
        elif x == "*" or s.word(j):
            path.append(x)
        j += 1
    if path:
        out["imports_raw"].append({"module": "::".join(path[:-1]), "names": [path[-1]], "level": 0, "alias": alias})
