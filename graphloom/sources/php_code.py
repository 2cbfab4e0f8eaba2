"""PHP files to nodes, edges and symbols, and findings in them (SRC5, BG1-BG4, A8, UDF2).

One pass over a file's tokens: declarations open scopes, and the tokens of each body are read for
calls with the types that parameters, properties and assignments give.  A file whose brackets don't
close gives no rows.  Rows of a file don't depend on other files; targets that are not known are kept
and resolved when the graph is put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources import php_tokens as T

_PARAM = pa.struct([("name", pa.string()), ("type", pa.string())])
SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("class", pa.string()), ("method", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("type", pa.string()),
        ("visibility", pa.string()), ("is_static", pa.bool_()), ("end_line", pa.int32()), ("params", pa.list_(_PARAM)), ("returned", pa.string()), ("attributes", pa.list_(pa.string())),
        ("is_interface", pa.bool_()), ("is_trait", pa.bool_()), ("cyclomatic", pa.int64()), ("name", pa.string()),
    ]
)
ROWS = (
    "kind string, path string, line int, class string, method string, src string, dst string, type string, visibility string, is_static boolean, end_line int, "
    "params array<struct<name:string,type:string>>, returned string, attributes array<string>, is_interface boolean, is_trait boolean, cyclomatic long, name string"
)

# Words that are no function calls, and types that are no classes.
WORDS = frozenset(
    "if elseif while for foreach switch match catch function fn array list isset unset empty echo print exit die return include include_once require require_once new clone and or xor use declare static".split()
)
SCALARS = frozenset("int float string bool array mixed void null never callable iterable object false true self static parent".split())
# Value classes whose instantiation says nothing about structure.
VALUES = frozenset("DateTime DateTimeImmutable DateInterval DateTimeZone stdClass ArrayObject ArrayIterator SplObjectStorage SplFileInfo Closure".split())
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
RELATIONS = frozenset("hasMany hasOne belongsTo belongsToMany hasOneThrough hasManyThrough morphTo morphMany morphOne morphToMany morphedByMany".split())
HTTP_VERBS = frozenset("get post put patch delete head".split())


@dataclass
class Method:
    """A method or function with the range of its body's tokens."""

    cls: str | None
    name: str
    line: int
    end: int
    params: list[tuple[str, str]]
    returned: str | None
    visibility: str
    static: bool
    attributes: list[str]
    body: tuple[int, int] | None
    id: str


@dataclass
class Class:
    name: str
    kind: str
    line: int
    parent: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


class PhpFile:
    def __init__(self, path: str, text: str):
        self.path, self.ts = path, T.script(text)
        self.namespace, self.rows = "", []
        self.classes: dict[str, str] = {}
        self.functions: dict[str, str] = {}
        self.methods: list[Method] = []
        self.own: dict[str, Class] = {}
        depth = 0
        for t in self.ts:
            if t.kind == "op":
                depth += (t.text in ("(", "[", "{", "#[")) - (t.text in (")", "]", "}"))
        self.whole = depth == 0
        if self.whole:
            for kind, alias, full in T.uses(self.ts):
                if kind != "const":
                    (self.classes if kind == "class" else self.functions)[alias.lower()] = full
            self._top(0, len(self.ts))
            for m in self.methods:
                if m.body:
                    self._body(m.id, *m.body, self._types(m), self.own.get(m.cls or ""))

    # ---- names

    def class_name(self, name: str, cls: Class | None = None) -> str | None:
        """The full name of a class in this file's scope; null for types that are none."""
        low = name.lower()
        if low in ("self", "static"):
            return cls.name if cls else None
        if low == "parent":
            return cls.parent if cls else None
        if low in SCALARS:
            return None
        if name.startswith("\\"):
            return name[1:]
        head, _, tail = name.partition("\\")
        if low.startswith("namespace\\"):
            return self._here(tail)
        if head.lower() in self.classes:
            return self.classes[head.lower()] + ("\\" + tail if tail else "")
        return self._here(name)

    def _here(self, name: str) -> str:
        return f"{self.namespace}\\{name}" if self.namespace else name

    def _type(self, lo: int, hi: int) -> str | None:
        return "".join(t.text for t in self.ts[lo:hi]) or None

    def _class_of_type(self, text: str | None, cls: Class | None) -> str | None:
        for part in (text or "").lstrip("?").replace("&", "|").strip("()").split("|"):
            if part and (found := self.class_name(part.strip("()"), cls)):
                return found
        return None

    def _types(self, m: Method) -> dict[str, str]:
        cls = self.own.get(m.cls or "")
        return {name: found for name, kind in m.params if (found := self._class_of_type(kind, cls))}

    # ---- declarations

    def _add(self, kind: str, line: int, **more) -> None:
        self.rows.append({"kind": kind, "path": self.path, "line": line, **more})

    def _edge(self, src: str, dst: str, kind: str, line: int, method: str) -> None:
        self._add("edge", line, src=src, dst=dst, type=kind, method=method)

    def _top(self, k: int, end: int) -> None:
        ts, loose, attributes = self.ts, [], []
        while k < end:
            t, low = ts[k], ts[k].text.lower()
            if t.text == "#[":
                close = T.closing(ts, k)
                attributes += self._attributes(k, close)
                k = close + 1
            elif t.kind == "name" and low == "namespace" and ts[k + 1 : k + 2] and ts[k + 1].text != "\\":
                self.namespace = ts[k + 1].text if ts[k + 1].kind == "name" else ""
                k = next((j for j in range(k, end) if ts[j].text in (";", "{")), end)
                if k < end and ts[k].text == "{":
                    close = T.closing(ts, k)
                    self._top(k + 1, close)
                    k = close
                k += 1
            elif t.kind == "name" and low in ("use", "declare"):
                k = next((j for j in range(k, end) if ts[j].text == ";"), end) + 1
            elif t.kind == "name" and low in ("class", "interface", "trait", "enum") and k + 1 < end and ts[k + 1].kind == "name" and (k == 0 or ts[k - 1].text not in ("::", "->", "new")):
                k = self._class(k, attributes)
                attributes = []
            elif t.kind == "name" and low in ("abstract", "final", "readonly"):
                k += 1
            elif t.kind == "name" and low == "function" and k + 1 < end and (ts[k + 1].kind == "name" or (ts[k + 1].text == "&" and ts[k + 2].kind == "name")):
                k = self._function(k, None, set(), attributes)
                attributes = []
            elif t.kind == "name" and low == "const" and k + 1 < end and ts[k + 1].kind == "name":
                self._add("symbol", t.line, name=self._here(ts[k + 1].text), type="const")
                k = next((j for j in range(k, end) if ts[j].text == ";"), end) + 1
            else:
                stop = k
                while stop < end and ts[stop].text != ";" and not (ts[stop].text == "{" and ts[stop].kind == "op"):
                    stop = T.closing(ts, stop) + 1 if ts[stop].text in ("(", "[") and ts[stop].kind == "op" else stop + 1
                if stop < end and ts[stop].text == "{":
                    stop = T.closing(ts, stop)
                if any(x.kind != "html" and x.text != ";" for x in ts[k : stop + 1]):
                    loose.append((k, min(stop + 1, end)))
                k = stop + 1
        if loose:  # code outside of functions: the file is a script
            own = f"file:{self.path}"
            if not any(r.get("src") == own and r["kind"] == "node" for r in self.rows):
                self._add("node", self.ts[loose[0][0]].line, **{"class": self.path}, method="__file__", src=own, type="file", visibility="public")
            env: dict[str, str] = {}
            for lo, hi in loose:
                self._body(own, lo, hi, env, None)

    def _attributes(self, k: int, close: int) -> list[str]:
        return [self.ts[a].text.rpartition("\\")[2] for a, b in T.parts(self.ts, k + 1, close) if self.ts[a].kind == "name"]

    def _class(self, k: int, attributes: list[str]) -> int:
        ts = self.ts
        kind, name = ts[k].text.lower(), self._here(ts[k + 1].text)
        body = next((j for j in range(k + 2, len(ts)) if ts[j].text == "{"), len(ts) - 1)
        cls = self.own[name] = Class(name, kind, ts[k].line)
        own, mode = f"{name}::__construct", None
        for j in range(k + 2, body):
            low = ts[j].text.lower()
            if ts[j].kind != "name":
                continue
            if low in ("extends", "implements"):
                mode = low
            elif mode and (target := self.class_name(ts[j].text)):
                if mode == "extends" and kind == "class":
                    cls.parent = target
                    self._edge(own, f"{target}::__parent", "inherits", ts[j].line, "extends")
                else:
                    self._edge(own, f"{target}::__interface", "interface_implementation", ts[j].line, mode)
        close = T.closing(ts, body)
        j, modifiers, held = body + 1, set(), list(attributes) if kind == "interface" else []
        start = j
        while j < close:
            t, low = ts[j], ts[j].text.lower()
            if t.text == "#[":
                end = T.closing(ts, j)
                held += self._attributes(j, end)
                j = start = end + 1
            elif t.kind == "name" and low in MODIFIERS:
                modifiers.add(low)
                j += 1
                start = j
            elif t.kind == "name" and low == "use":
                while ts[j].text not in (";", "{"):
                    if ts[j].kind == "name" and ts[j].text.lower() != "use" and (target := self.class_name(ts[j].text)):
                        self._edge(own, f"{target}::__trait", "trait_usage", ts[j].line, "use")
                    j += 1
                j = start = (T.closing(ts, j) if ts[j].text == "{" else j) + 1
            elif t.kind == "name" and low == "function":
                j = start = self._function(j, cls, modifiers, held)
                modifiers, held = set(), []
            elif t.kind == "var":
                if found := self._class_of_type(self._type(start, j), cls):
                    cls.properties[t.text[1:]] = found
                j = next((x for x in range(j, close) if ts[x].text in (";", "{")), close)
                j = start = (T.closing(ts, j) if j < close and ts[j].text == "{" else j) + 1
                modifiers, held = set(), []
            elif t.kind == "name" and low in ("const", "case"):
                j = start = next((x for x in range(j, close) if ts[x].text == ";"), close) + 1
                modifiers, held = set(), []
            else:
                j += 1
        return close + 1

    def _function(self, k: int, cls: Class | None, modifiers: set[str], attributes: list[str]) -> int:
        ts, line = self.ts, self.ts[k].line
        k += 2 if ts[k + 1].text == "&" else 1
        name, opening = ts[k].text, next((j for j in range(k, len(ts)) if ts[j].text == "("), len(ts) - 1)
        close = T.closing(ts, opening)
        params = []
        for lo, hi in T.parts(ts, opening + 1, close):
            while lo < hi and ts[lo].text == "#[":
                lo = T.closing(ts, lo) + 1
            promoted = False
            while lo < hi and ts[lo].kind == "name" and ts[lo].text.lower() in MODIFIERS:
                promoted, lo = True, lo + 1
            var = next((j for j in range(lo, hi) if ts[j].kind == "var"), None)
            if var is None:
                continue
            kind = "".join(t.text for t in ts[lo:var] if t.text not in ("&", "...")) or None
            params.append((ts[var].text[1:], kind))
            if promoted and cls and (found := self._class_of_type(kind, cls)):
                cls.properties[ts[var].text[1:]] = found
        at = close + 1
        returned = None
        if at < len(ts) and ts[at].text == ":":
            end = next((j for j in range(at, len(ts)) if ts[j].text in ("{", ";")), len(ts))
            returned, at = self._type(at + 1, end), end
        body = (at + 1, T.closing(ts, at)) if at < len(ts) and ts[at].text == "{" else None
        last = min(body[1] if body else at, len(ts) - 1)
        visibility = next((v for v in ("private", "protected") if v in modifiers), "public")
        id_ = f"{cls.name}::{name}" if cls else f"func:{self._here(name)}"
        found = Method(cls.name if cls else None, name, line, ts[last].line, params, returned, visibility, "static" in modifiers, list(attributes), body, id_)
        self.methods.append(found)
        self._add(
            "node", line, **{"class": found.cls or self.namespace}, method=name, src=id_, type="method" if cls else "function", visibility=visibility, is_static=found.static, end_line=found.end,
            params=[{"name": n, "type": normal_type(t)} for n, t in params], returned=returned, attributes=found.attributes,
            is_interface=bool(cls and cls.kind == "interface"), is_trait=bool(cls and cls.kind == "trait"), cyclomatic=branches(ts[body[0] : body[1]]) if body else 1,
        )
        if cls is None:
            self._add("symbol", line, name=self._here(name), type="function")
        return last + 1

    # ---- bodies

    def _receiver(self, k: int, env: dict[str, str], cls: Class | None) -> str | None:
        """The class of what ends before the arrow at this place: $this, $v, $this->p, or (new X)."""
        ts = self.ts
        if k < 1:
            return None
        t = ts[k - 1]
        if t.kind == "var":
            return cls.name if t.text == "$this" and cls else env.get(t.text[1:])
        if t.kind == "name" and k >= 3 and ts[k - 2].text in ("->", "?->") and ts[k - 3].text == "$this" and cls:
            return cls.properties.get(t.text)
        if t.text == ")":
            depth, j = 0, k - 1
            while j >= 0:
                depth += (ts[j].text == ")") - (ts[j].text == "(")
                if not depth:
                    break
                j -= 1
            if j >= 0 and ts[j + 1].text.lower() == "new" and ts[j + 2].kind == "name":
                return self.class_name(ts[j + 2].text, cls)
            if j >= 2 and ts[j - 2].text.lower() == "new":
                return self.class_name(ts[j - 1].text, cls)
        return None

    def _body(self, src: str, lo: int, hi: int, env: dict[str, str], cls: Class | None) -> None:
        ts = self.ts
        for k in range(lo, hi):
            t, low = ts[k], ts[k].text.lower()
            nxt = ts[k + 1].text if k + 1 < hi else ""
            before = ts[k - 1].text if k > lo else ""
            if t.kind == "var" and nxt == "=" and k + 3 < hi and ts[k + 2].text.lower() == "new" and ts[k + 3].kind == "name":
                if found := self.class_name(ts[k + 3].text, cls):
                    env[t.text[1:]] = found
            elif t.kind == "op" and t.text in ("->", "?->") and k + 1 < hi and ts[k + 1].kind == "name":
                member, target = ts[k + 1].text, self._receiver(k, env, cls)
                called = k + 2 < hi and ts[k + 2].text == "("
                if called and cls and ts[k - 1].text == "$this" and member in RELATIONS:
                    self._relation(k + 2, cls, member, t.line)
                if target and called:
                    self._edge(src, f"{target}::{member}", "method_call", t.line, member)
                elif target and ts[k - 1].text != "$this":
                    self._edge(src, f"{target}::{member}", "property_access", t.line, member)
            elif t.kind == "name" and nxt == "::" and k + 2 < hi:
                target, member = self.class_name(t.text, cls), ts[k + 2]
                called = k + 3 < hi and ts[k + 3].text == "("
                if target and called and member.kind == "name":
                    if t.text.rpartition("\\")[2] == "Http" and member.text.lower() in HTTP_VERBS:
                        args = T.arguments(ts, k + 3)
                        if args and (url := T.string_of(args[0])):
                            self._edge(src, f"http:{member.text.upper()}:{url}", "http_call", t.line, member.text.lower())
                            continue
                    self._edge(src, f"{target}::{member.text}", "static_call", t.line, member.text)
                elif target and member.kind == "var":
                    self._edge(src, f"{target}::{member.text[1:]}", "static_property", t.line, member.text[1:])
            elif t.kind == "name" and low == "new" and k + 1 < hi and ts[k + 1].kind == "name":
                target = self.class_name(ts[k + 1].text, cls)
                short = (target or "").rpartition("\\")[2]
                if target and not (short.endswith(("Exception", "DTO", "Enum", "ValueObject")) or short in VALUES):
                    self._edge(src, f"{target}::__construct", "direct_instantiation", t.line, "__construct")
            elif t.kind == "name" and low in ("include", "include_once", "require", "require_once"):
                self._include(src, k, hi)
            elif t.kind == "name" and nxt == "(" and low not in WORDS and before not in ("->", "?->", "::", "new", "function") and low not in MODIFIERS:
                if low in ("add_action", "add_filter"):
                    self._hook(src, k, cls)
                full = self.functions.get(low) or (t.text[1:] if t.text.startswith("\\") else self._here(t.text))
                self._edge(src, f"func:{full}", "function_call", t.line, t.text.rpartition("\\")[2])

    def _relation(self, at: int, cls: Class, member: str, line: int) -> None:
        args = T.arguments(self.ts, at)
        if args and (name := T.class_of(args[0])) and (target := self.class_name(name, cls)):
            own = f"{cls.name}::__model"
            if not any(r["kind"] == "node" and r.get("src") == own for r in self.rows):
                self._add("node", cls.line, **{"class": cls.name}, method="__model", src=own, type="method", visibility="public")
            self._edge(own, f"{target}::__model", "model_relationship", line, member)

    def _include(self, src: str, k: int, hi: int) -> None:
        ts, folder = self.ts, self.path.rpartition("/")[0]
        j = k + 1
        here = False
        while j < hi and ts[j].text in ("(", "__DIR__", "."):
            here |= ts[j].text == "__DIR__"
            j += 1
        if j < hi and ts[j].kind == "string":
            parts = []
            for x in f"{folder}/{ts[j].text}".split("/") if here or not ts[j].text.startswith("/") else ts[j].text.split("/"):
                if x == "..":
                    parts = parts[:-1]
                elif x not in ("", "."):
                    parts.append(x)
            self._edge(src, "file:" + "/".join(parts), "include", ts[k].line, ts[k].text.lower())

    def _hook(self, src: str, k: int, cls: Class | None) -> None:
        args = T.arguments(self.ts, k + 1)
        if len(args) < 2:
            return
        target = T.string_of(args[1])
        if target:
            self._edge(src, target.lstrip("\\") if "::" in target else f"func:{target}", "wp_hook", self.ts[k].line, T.string_of(args[0]) or "")
        elif args[1][0].text == "[" and cls and len(inner := T.arguments(args[1], 0)) == 2 and inner[0][0].text == "$this" and (name := T.string_of(inner[1])):
            self._edge(src, f"{cls.name}::{name}", "wp_hook", self.ts[k].line, T.string_of(args[0]) or "")


def normal_type(text: str | None) -> str:
    """UDF2: a parameter's type as a caller sees it: mixed without one, nullable as a union with null."""
    if not text:
        return "mixed"
    return f"{text[1:]}|null" if text.startswith("?") else text


def branches(ts: list[T.Token]) -> int:
    """1 + branch points of a body's tokens; else if is its if, a match arm counts like a case."""
    total, arms = 1, []
    for k, t in enumerate(ts):
        low = t.text.lower()
        if t.kind == "name":
            if low == "match" and k + 1 < len(ts) and ts[k + 1].text == "(":
                body = T.closing(ts, k + 1) + 1
                if body < len(ts) and ts[body].text == "{":
                    arms.append((body, T.closing(ts, body)))
            total += low in ("if", "elseif", "for", "foreach", "while", "case", "catch", "and", "or", "xor") or (low == "default" and k + 1 < len(ts) and ts[k + 1].text == ":")
        elif t.kind == "op":
            # A question mark before a type makes it nullable and is no branch.
            nullable = t.text == "?" and k + 1 < len(ts) and ts[k + 1].kind == "name" and k and ts[k - 1].text in ("(", ",", ":")
            total += t.text in ("&&", "||", "??") or (t.text == "?" and not nullable)
    return total + sum(len(T.parts(ts, lo + 1, hi)) for lo, hi in arms)


# ---- findings

# Functions that open a resource, and those that close one.
OPENERS = frozenset("fopen popen opendir tmpfile curl_init fsockopen proc_open stream_socket_client".split())
CLOSERS = frozenset("fclose pclose closedir curl_close proc_close".split())


def _statements(ts: list[T.Token], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of the statements of a body; a block belongs to the statement that opens it."""
    k = start = lo
    while k < hi:
        text, op = ts[k].text, ts[k].kind == "op"
        if op and text in ("(", "["):
            k = T.closing(ts, k) + 1
        elif op and text == "{":
            k = T.closing(ts, k) + 1
            if not (k < hi and ts[k].text.lower() in ("else", "elseif", "catch", "finally", "while")):
                yield start, min(k, hi)
                start = k
        elif op and text == ";":
            yield start, k + 1
            k = start = k + 1
        else:
            k += 1
    if start < hi:
        yield start, hi


def _fallback(ts: list[T.Token], returned: str | None) -> bool:
    """A literal that the declared return type asks for is a decision, not an accident."""
    kinds = {x.strip("?").lower() for x in (returned or "").split("|")}
    first = ts[0].text.lower()
    return (first in ("true", "false") and bool(kinds & {"bool", first})) or (first == "[" and "array" in kinds) or (ts[0].kind == "string" and "string" in kinds) or (ts[0].kind == "number" and bool(kinds & {"int", "float"}))


def _catch_verdict(ts: list[T.Token], lo: int, hi: int, returned: str | None) -> str | None:
    """What an exception handler does: nothing (swallowing), one call as a way out (graceful), or enough (null)."""
    body = list(_statements(ts, lo, hi))
    if not body:
        return "exception_swallowing"
    a, b = body[0]
    if len(body) > 1 or ts[a].text.lower() != "return":
        return None
    value = [t for t in ts[a + 1 : b] if t.text != ";"]
    if not value or (len(value) == 1 and value[0].text.lower() == "null"):
        return "exception_swallowing"
    if value[0].text.lower() == "new" or (value[-1].text == ")" and value[0].kind in ("name", "var")):
        return "graceful_degradation"
    return None if _fallback(value, returned) else "exception_swallowing"


def _null_uses(ts: list[T.Token], lo: int, hi: int) -> Iterator[int]:
    """Lines of assignments of a call's result that is used as an object before any test of it."""
    body = list(_statements(ts, lo, hi))
    for n, (a, b) in enumerate(body):
        if not (ts[a].kind == "var" and a + 2 < b and ts[a + 1].text == "=" and ts[b - 1].text == ";" and ts[b - 2].text == ")"):
            continue
        if ts[a + 2].text.lower() == "new" or any(t.text in ("??", "?") for t in ts[a:b]):
            continue
        names = [ts[k].text for k in range(a + 2, b - 1) if ts[k].kind == "name" and ts[k + 1].text == "("]
        if not names or names[-1].lower().startswith("must") or names[-1].endswith(("OrFail", "OrCreate", "OrNew")):
            continue
        for x, y in body[n + 1 :]:
            if ts[x].text.lower() in ("if", "while") and any(t.text == ts[a].text for t in ts[x:y]):
                break
            if ts[x].text == ts[a].text and ts[x + 1].text == "=":
                break
            if ts[x].text == ts[a].text and ts[x + 1].text == "->" and x + 3 < y and ts[x + 3].text == "(":
                yield ts[a].line
                break


def php_bugs(path: str, text: str) -> list[dict]:
    """BG1-BG4: missing return types, swallowed exceptions, unclosed resources, results used without a test."""
    file, out = PhpFile(path, text), []
    for m in file.methods:

        def add(kind: str, confidence: float, line: int, node: str = m.id) -> None:
            out.append({"path": path, "node_id": node, "type": kind, "confidence": confidence, "line": line})

        if m.cls and m.visibility == "public" and not m.name.startswith("__") and m.returned is None:
            add("missing_return_type", 0.5, m.line)
        if not m.body:
            continue
        ts, (lo, hi) = file.ts, m.body
        for k in range(lo, hi):
            if ts[k].kind == "name" and ts[k].text.lower() == "catch" and ts[k + 1].text == "(":
                body = T.closing(ts, k + 1) + 1
                if body < hi and (verdict := _catch_verdict(ts, body + 1, T.closing(ts, body), m.returned)):
                    add(verdict, 0.9, ts[k].line)
        called = [ts[k].text.lstrip("\\").lower() for k in range(lo, hi - 1) if ts[k].kind == "name" and ts[k + 1].text == "("]
        if sum(x in OPENERS for x in called) > sum(x in CLOSERS for x in called):
            add("resource_leak", 0.8, m.line)
        for line in _null_uses(ts, lo, hi):
            add("null_dereference", 0.8, line)
    return out


def php_complexities(path: str, text: str) -> list[dict]:
    """(path, node_id, cyclomatic) of every method and function."""
    return [{"path": path, "node_id": r["src"], "cyclomatic": r["cyclomatic"]} for r in PhpFile(path, text).rows if r["kind"] == "node" and r.get("cyclomatic")]


def php_files(files: DataFrame) -> DataFrame:
    """SRC5: rows of kind node, edge and symbol for every file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                file = PhpFile(path, text or "")
                if file.whole and file.rows:
                    yield pa.RecordBatch.from_pylist(file.rows, schema=SCHEMA)

    return files.select("path", "content").mapInArrow(run, ROWS)
