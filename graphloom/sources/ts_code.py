"""TypeScript and JavaScript files to nodes, edges and symbols (SRC7).

A file is cut into tokens (regular expressions, templates and markup are told apart by what stands
before them), functions are found with the ranges of their bodies, and calls belong to the innermost
function around them, or to the module.  Imported names lead to keys ``ts_import:<module>::<name>``,
which are resolved when the graph is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("class", pa.string()), ("method", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("type", pa.string()),
        ("entrypoint_type", pa.string()), ("http_method", pa.string()), ("http_path", pa.string()), ("exported", pa.bool_()), ("name", pa.string()),
    ]
)
ROWS = (
    "kind string, path string, line int, class string, method string, src string, dst string, type string, entrypoint_type string, http_method string, http_path string, exported boolean, name string"
)

# Endings of code files, words that are no calls, verbs.
ENDINGS = (".d.ts", ".tsx", ".ts", ".jsx", ".mjs", ".cjs", ".js")
WORDS = frozenset("if for while switch catch return typeof function await async new super import require constructor do else in of instanceof void delete yield throw case with".split())
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
HANDLERS = frozenset("GET POST PUT PATCH DELETE HEAD OPTIONS".split())
ROUTERS = frozenset("app router server api fastify".split())
CLIENTS = frozenset("axios http client api $http ky got request".split())


class Token(NamedTuple):
    kind: str  # name, string, template, regex, number, op
    text: str
    line: int


_PLAIN = re.compile(r"[A-Za-z_$#\x80-\U0010ffff][\w$\x80-\U0010ffff]*|\d[\w.]*|=>|\?\.|\.\.\.|[=!]==?|&&|\|\||\?\?|\+\+|--|.", re.S)
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
#: A slash after one of these divides; after anything else it begins a regular expression.
_VALUE_END = frozenset(")]}")


def _template_end(text: str, at: int) -> int:
    """The place behind a template that begins at this place; inner templates are skipped whole."""
    depth, k = [], at + 1
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif depth and c in "{}":
            if c == "{":
                depth[-1] += 1
            else:
                depth[-1] -= 1
                if not depth[-1]:
                    depth.pop()
        elif not depth and c == "`":
            return k + 1
        elif depth and c == "`":
            k = _template_end(text, k) - 1
        elif not depth and text.startswith("${", k):
            depth.append(1)
            k += 1
        k += 1
    return len(text)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        if space := _SPACE.match(text, at):
            line += space[0].count("\n")
            at = space.end()
            continue
        c, last = text[at], out[-1] if out else None
        if c in "'\"" and (m := _STRING.match(text, at)):
            out.append(Token("string", m[0][1:-1], line))
        elif c == "`":
            end = _template_end(text, at)
            out.append(Token("template", text[at + 1 : end - 1], line))
            line += text.count("\n", at, end)
            at = end
            continue
        elif c == "/" and (last is None or not (last.kind in ("name", "number", "string", "template") or last.text in _VALUE_END) or last.text in ("return", "typeof", "case")) and (m := _REGEX.match(text, at)):
            out.append(Token("regex", m[0], line))
        else:
            m = _PLAIN.match(text, at)
            kind = "name" if re.match(r"[A-Za-z_$#\x80-\U0010ffff]", c) else "number" if c.isdigit() else "op"
            out.append(Token(kind, m[0], line))
        at = m.end()
    return out


_PAIRS = {"(": ")", "[": "]", "{": "}"}


class TsFile:
    def __init__(self, path: str, text: str):
        self.path, self.ts = path, tokens(text)
        stem = path
        for ending in ENDINGS:
            if stem.endswith(ending):
                stem = stem.removesuffix(ending)
                break
        self.language = "typescript" if path.endswith((".ts", ".tsx")) else "javascript"
        self.module = stem.strip("/").replace("/", ".")
        self.close = self._brackets()
        self.rows: list[dict] = []
        self.imports: dict[str, tuple[str, str]] = {}
        self.spans: list[tuple[int, int, str, str | None]] = []  # begin, end, id, class
        self.own: dict[str, str] = {}
        self.exported: set[str] = set()
        self._imported()
        self._declared(0, len(self.ts), None)
        self._called()
        self._routed()

    def _brackets(self) -> dict[int, int]:
        stack, close = [], {}
        for k, t in enumerate(self.ts):
            if t.kind == "op" and t.text in _PAIRS:
                stack.append(k)
            elif t.kind == "op" and t.text in _VALUE_END:
                while stack and _PAIRS[self.ts[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    close[stack.pop()] = k
        return close

    def _end(self, k: int) -> int:
        return self.close.get(k, len(self.ts) - 1)

    def _id(self, cls: str | None, name: str) -> str:
        return f"{self.language}:{self.module}{'.' + cls if cls else ''}::{name}"

    def _add(self, kind: str, line: int, **more) -> None:
        self.rows.append({"kind": kind, "path": self.path, "line": line, **more})

    def target_module(self, name: str) -> str:
        """The module that an import names: relative paths from this file's folder."""
        if not name.startswith("."):
            return name
        parts = self.path.strip("/").split("/")[:-1]
        for x in name.split("/"):
            if x == "..":
                parts = parts[:-1]
            elif x not in ("", "."):
                parts.append(x)
        joined = ".".join(parts)
        for ending in ENDINGS:
            if joined.endswith(ending):
                return joined.removesuffix(ending)
        return joined

    def _imported(self) -> None:
        ts = self.ts
        for k, t in enumerate(ts):
            if t.text == "import" and t.kind == "name" and not (k and ts[k - 1].text == "."):
                source = next((j for j in range(k + 1, min(k + 400, len(ts))) if ts[j].kind == "string" or ts[j].text == ";"), None)
                if source is None or ts[source].kind != "string" or (ts[k + 1].text == "(" and source == k + 2):
                    continue
                module, names = self.target_module(ts[source].text), ts[k + 1 : source]
                self._add("symbol", t.line, name=module, type="import")
                j, braces = 0, False
                while j < len(names):
                    x = names[j]
                    if x.text in "{}":
                        braces = x.text == "{"
                    elif x.text == "*" and j + 2 < len(names) and names[j + 1].text == "as":
                        self.imports[names[j + 2].text] = (module, "*")
                        j += 2
                    elif x.kind == "name" and x.text not in ("from", "type", "as"):
                        alias = names[j + 2].text if j + 2 < len(names) and names[j + 1].text == "as" else x.text
                        self.imports[alias] = (module, x.text if braces else "default")
                        j += 2 if alias != x.text else 0
                    j += 1
            elif t.text == "require" and k + 2 < len(ts) and ts[k + 1].text == "(" and ts[k + 2].kind == "string" and k >= 2 and ts[k - 1].text == "=":
                module = self.target_module(ts[k + 2].text)
                if ts[k - 2].kind == "name":
                    self.imports[ts[k - 2].text] = (module, "*")
                elif ts[k - 2].text == "}":
                    j = k - 3
                    while j >= 0 and ts[j].text != "{":
                        if ts[j].kind == "name":
                            self.imports[ts[j].text] = (module, ts[j].text)
                        j -= 1

    def _node(self, k: int, cls: str | None, name: str, span: tuple[int, int]) -> None:
        exported = cls is None and any(self.ts[j].text == "export" for j in range(max(0, k - 4), k + 1))
        id_ = self._id(cls, name)
        route = {}
        file = self.path.rpartition("/")[2]
        if cls is None and name in HANDLERS and exported and file.startswith("route."):
            folder = re.sub(r"^.*?(?:^|/)app(?=/)", "", "/" + self.path.strip("/")).rpartition("/")[0]
            route = {"entrypoint_type": "http", "http_method": name, "http_path": re.sub(r"\[(?:\.\.\.)?(\w+)\]", r"{\1}", folder) or "/"}
        self._add("node", self.ts[k].line, **{"class": f"{self.module}.{cls}" if cls else self.module}, method=name, src=id_, exported=exported, **route)
        self.spans.append((*span, id_, cls))
        self.own[f"{cls}.{name}" if cls else name] = id_
        if exported:
            self._add("symbol", self.ts[k].line, name=name, type="export")

    def _body(self, k: int) -> tuple[int, int] | None:
        """The range of a body that follows a list of parameters closed at this place, behind a type; null without a body."""
        ts, j = self.ts, k + 1
        if j < len(ts) and ts[j].text == ":":
            j += 1
            while j < len(ts) and ts[j].text not in ("=>", ";"):
                if ts[j].text == "{" and ts[j - 1].text not in (":", "|", "&", "<", ","):
                    break
                j = self._end(j) + 1 if ts[j].text in _PAIRS else j + 1
        return (j, self._end(j)) if j < len(ts) and ts[j].text == "{" else None

    def _arrow(self, k: int) -> tuple[int, int] | None:
        """The body's range of an arrow function whose parameters begin at this place."""
        ts = self.ts
        if k < len(ts) and ts[k].text == "async":
            k += 1
        if k < len(ts) and ts[k].text == "(":
            j = self._end(k) + 1
            if j < len(ts) and ts[j].text == ":":
                while j < len(ts) and ts[j].text not in ("=>", ";", "="):
                    j = self._end(j) + 1 if ts[j].text in _PAIRS else j + 1
        else:
            j = k + 1
        if j >= len(ts) or ts[j].text != "=>":
            return None
        j += 1
        if j < len(ts) and ts[j].text == "{":
            return j, self._end(j)
        end = j
        while end < len(ts) and ts[end].text not in (";", ",") and not (end > j and ts[end].line > ts[end - 1].line and ts[end].text in ("const", "let", "var", "export", "function", "class")):
            if ts[end].text in _VALUE_END:
                break
            end = self._end(end) + 1 if ts[end].text in _PAIRS else end + 1
        return j, max(j, end - 1)

    def _declared(self, lo: int, hi: int, cls: str | None) -> None:
        """Functions and classes; those inside functions belong to the function around them."""
        ts, k = self.ts, lo
        while k < hi:
            t = ts[k]
            prior = ts[k - 1].text if k else ""
            if cls is None and t.text == "function" and t.kind == "name":
                j = k + 1 + (k + 1 < hi and ts[k + 1].text == "*")
                if j < hi and (ts[j].kind == "name" or ts[j].text == "("):
                    name = ts[j].text if ts[j].kind == "name" else "default"
                    opening = next((x for x in range(j, hi) if ts[x].text == "("), None)
                    body = self._body(self._end(opening)) if opening is not None else None
                    if body:
                        if ts[j].kind == "name" or prior == "default":
                            self._node(k, None, name, body)
                        k = body[1] + 1
                        continue
            elif cls is None and t.text == "class" and t.kind == "name" and prior != "." and k + 1 < hi:
                name = ts[k + 1].text if ts[k + 1].kind == "name" and ts[k + 1].text != "extends" else "default"
                opening = next((x for x in range(k, hi) if ts[x].text == "{"), None)
                if opening is None:
                    return
                self._heritage(k, opening, name)
                self._declared(opening + 1, self._end(opening), name)
                k = self._end(opening) + 1
                continue
            elif cls is None and t.text in ("const", "let", "var") and k + 2 < hi and ts[k + 1].kind == "name":
                j = k + 2
                while j < hi and ts[j].text not in ("=", ";", ",") and ts[j].line == t.line:
                    j = self._end(j) + 1 if ts[j].text in _PAIRS else j + 1
                if j + 1 < hi and ts[j].text == "=":
                    body = self._arrow(j + 1)
                    if body is None and ts[j + 1].text == "function":
                        opening = next((x for x in range(j, hi) if ts[x].text == "("), None)
                        body = self._body(self._end(opening)) if opening is not None else None
                    if body:
                        self._node(k, None, ts[k + 1].text, body)
                        k = body[1] + 1
                        continue
            elif cls is not None and t.kind == "name" and k + 1 < hi and ts[k + 1].text in ("(", "<", "="):
                if ts[k + 1].text == "=":
                    body = self._arrow(k + 2)
                else:
                    opening = next((x for x in range(k, hi) if ts[x].text == "("), None)
                    body = self._body(self._end(opening)) if opening is not None else None
                if body and t.text not in ("if", "for", "while", "switch", "catch"):
                    self._node(k, cls, t.text, body)
                    k = body[1] + 1
                    continue
            k = self._end(k) + 1 if ts[k].text in _PAIRS and (cls is not None or ts[k].text != "{") and self._skips(k) else k + 1

    def _skips(self, k: int) -> bool:
        """Brackets whose inside declares nothing at this level."""
        return self.ts[k].text in ("[", "{") or not any(self.ts[j].text in ("function", "class", "=>") for j in range(k, self._end(k)))

    def _heritage(self, k: int, opening: int, name: str) -> None:
        mode = None
        for j in range(k + 2, opening):
            t = self.ts[j]
            if t.text in ("extends", "implements"):
                mode = t.text
            elif t.kind == "name" and mode and self.ts[j - 1].text in ("extends", "implements", ","):
                kind = "inherits" if mode == "extends" else "interface_implementation"
                mark = "__parent" if mode == "extends" else "__interface"
                self._edge(self._id(name, "constructor"), f"{self._class(t.text)}::{mark}", kind, t.line, mode)

    def _class(self, name: str) -> str:
        if name in self.imports:
            module, original = self.imports[name]
            return f"ts_import:{module}::{name if original in ('default', '*') else original}"
        return f"{self.language}:{self.module}.{name}"

    def _edge(self, src: str, dst: str, kind: str, line: int, method: str) -> None:
        self._add("edge", line, src=src, dst=dst, type=kind, method=method)

    def _owner(self, k: int) -> tuple[str, str | None]:
        inside = [s for s in self.spans if s[0] <= k <= s[1]]
        if not inside:
            return self._id(None, "__module__"), None
        best = max(inside, key=lambda s: s[0])
        return best[2], best[3]

    def _argument(self, k: int) -> str | None:
        """The literal that a call's list begins with."""
        t = self.ts[k + 1] if k + 1 < len(self.ts) else None
        return t.text if t and t.kind in ("string", "template") else None

    def _called(self) -> None:
        ts = self.ts
        declared = {s[0] for s in self.spans}
        for k in range(len(ts) - 1):
            t = ts[k]
            if t.kind != "name" or ts[k + 1].text != "(" or t.text in WORDS:
                continue
            prior = ts[k - 1].text if k else ""
            body = self._body(self._end(k + 1))
            if prior == "function" or (body and body[0] in declared):
                continue
            src, cls = self._owner(k)
            if prior in (".", "?."):
                base = ts[k - 2] if k > 1 else None
                if base is not None and base.text == "this" and cls and f"{cls}.{t.text}" in self.own:
                    self._edge(src, self.own[f"{cls}.{t.text}"], "method_call", t.line, t.text)
                elif base is not None and base.kind == "name" and t.text in VERBS and (base.text in CLIENTS or base.text.endswith("Client")) and (url := self._argument(k + 1)) and base.text not in ROUTERS - CLIENTS and url[:1] in "/h$":
                    if not self._is_route(k):
                        self._edge(src, f"http:{t.text.upper()}:{_url(url)}", "http_call", t.line, t.text)
                elif base is not None and base.text in self.imports and ts[k - 3].text not in (".", "?.") if k > 2 else False:
                    module, _ = self.imports[base.text]
                    self._edge(src, f"ts_import:{module}::{t.text}", "import_call", t.line, t.text)
            elif prior == "new":
                self._edge(src, f"{self._class(t.text)}::constructor", "instantiation", t.line, t.text)
            elif t.text == "fetch" and (url := self._argument(k + 1)):
                inner = ts[k + 1 : self._end(k + 1)]
                verb = next((inner[j + 2].text.upper() for j in range(len(inner) - 2) if inner[j].text == "method" and inner[j + 1].text == ":" and inner[j + 2].kind == "string"), "GET")
                self._edge(src, f"http:{verb}:{_url(url)}", "http_call", t.line, "fetch")
            elif t.text in self.own:
                self._edge(src, self.own[t.text], "method_call", t.line, t.text)
            elif t.text in self.imports:
                module, original = self.imports[t.text]
                self._edge(src, f"ts_import:{module}::{t.text if original in ('default', '*') else original}", "import_call", t.line, t.text)
        if any(r["kind"] == "edge" and r["src"].endswith("::__module__") for r in self.rows):
            self._add("node", 1, **{"class": self.module}, method="__module__", src=self._id(None, "__module__"), exported=False)

    def _is_route(self, k: int) -> bool:
        """app.get('/x', handler): a router's call with a handler."""
        inner = self.ts[k + 1 : self._end(k + 1)]
        return self.ts[k - 2].text in ROUTERS and len(inner) > 3 and inner[2].text == "," and inner[1].kind == "string"

    def _routed(self) -> None:
        ts = self.ts
        nodes = {r["src"]: r for r in self.rows if r["kind"] == "node"}
        for k in range(2, len(ts) - 3):
            if ts[k].text in VERBS and ts[k - 1].text == "." and ts[k - 2].text in ROUTERS and ts[k + 1].text == "(" and self._is_route(k):
                end = self._end(k + 1)
                last = ts[end - 1].text
                if ts[end - 1].kind == "name" and last in self.own and (row := nodes.get(self.own[last])):
                    row |= {"entrypoint_type": "http", "http_method": ts[k].text.upper(), "http_path": re.sub(r":(\w+)", r"{\1}", ts[k + 2].text)}


def _url(text: str) -> str:
    """A template's inserted values become parameters."""
    return re.sub(r"\$\{[^}]*\}", "{*}", text)


def ts_files(files: DataFrame) -> DataFrame:
    """SRC7: rows of kind node, edge and symbol for every file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if rows := TsFile(path, text or "").rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return files.select("path", "content").mapInArrow(run, ROWS)
