"""Routes of a route file, read from its calls (SRC11): the plain form and the structured one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.sources import php_tokens as T

# Verbs of route calls, and what a resource stands for: verb, ending of the path, action.
VERBS = ("get", "post", "put", "patch", "delete", "options", "any")
RESOURCE = (("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{p}", "show"), ("GET", "/{p}/edit", "edit"), ("PUT", "/{p}", "update"), ("DELETE", "/{p}", "destroy"))
PATCHED = ("PATCH", "/{p}", "update")
API = ("index", "store", "show", "update", "destroy")

_COLUMNS = ("path", "method", "uri", "controller", "action")
ROUTES = "path string, method string, uri string, controller string, action string"


def _action(arg: list[T.Token]) -> tuple[str, str] | None:
    """(controller, action) of [X::class, 'm'], 'X@m', X::class or a closure."""
    if arg and arg[0].text == "[":
        inner = T.arguments(arg, 0)
        if len(inner) == 2 and (cls := T.class_of(inner[0])) and (name := T.string_of(inner[1])):
            return cls, name
        return None
    if (text := T.string_of(arg)) and "@" in text:
        cls, _, name = text.partition("@")
        return cls, name
    if arg and arg[0].kind == "name" and arg[0].text.lower() in ("function", "fn", "static"):
        return "Closure", "-"
    return (cls, "__invoke") if (cls := T.class_of(arg)) else None


def _full(name: str, imports: dict[str, str]) -> str:
    return name if name == "Closure" else name.lstrip("\\") if "\\" in name else imports.get(name, name)


def _resources(uri: str, api: bool) -> list[tuple[str, str, str]]:
    name = "{" + uri.rstrip("s") + "}"
    return [(verb, uri + tail.replace("{p}", name), action) for verb, tail, action in RESOURCE if not api or action in API]


def plain_routes(path: str, text: str) -> Iterator[tuple]:
    """Calls of Route with a verb, resource or apiResource: seven or five routes for a resource, closures kept."""
    ts = T.script(text)
    imports = {alias: full for kind, alias, full in T.uses(ts) if kind == "class"}
    for call in T.static_calls(ts, "Route"):
        verb, args = call.name.lower(), call.args
        uri = T.string_of(args[0]) if args else None
        if uri is None or len(args) < 2:
            continue
        if verb in ("resource", "apiresource") and (cls := T.class_of(args[1])):
            yield from ((path, v, u, _full(cls, imports), a) for v, u, a in _resources(uri, verb == "apiresource"))
        elif verb in (*VERBS, "match") and (target := _action(args[1])) and (verb != "match" or target[0] != "Closure") and target[1] != "__invoke":
            yield path, verb.upper(), uri, _full(target[0], imports), target[1]


def _words(arg: list[T.Token]) -> list[str]:
    return [x.text for x in arg if x.kind == "string"]


def _chain(ts: list[T.Token], at: int) -> dict[str, list[list[T.Token]]]:
    """Calls that follow ->name(...) after the call whose list opens at this place."""
    found, k = {}, T.closing(ts, at) + 1
    while k + 2 < len(ts) and ts[k].text == "->" and ts[k + 2].text == "(":
        found[ts[k + 1].text.lower()] = T.arguments(ts, k + 2)
        k = T.closing(ts, k + 2) + 1
    return found


def structured_routes(path: str, text: str) -> Iterator[tuple]:
    """The same with PATCH for resources, nested names (a.b), only and except, and one row per verb of match; closures are left out."""
    ts = T.script(text)
    imports = {alias: full for kind, alias, full in T.uses(ts) if kind == "class"}
    for call in T.static_calls(ts, "Route"):
        verb, args = call.name.lower(), call.args
        if verb in ("resource", "apiresource"):
            uri, cls = (T.string_of(args[0]) if args else None), (T.class_of(args[1]) if len(args) > 1 else None)
            if uri is None or cls is None:
                continue
            *above, last = uri.split(".")
            base = "".join(f"{x}/{{{x.rstrip('s')}}}/" for x in above) + last
            chain = _chain(ts, call.at + 3)
            only, without = ([w for a in chain.get(k, []) for w in _words(a)] for k in ("only", "except"))
            for v, tail, action in (*RESOURCE[:6], PATCHED, RESOURCE[6]):
                if (verb == "resource" or action in API) and (not only or action in only) and action not in without:
                    yield path, v, base + tail.replace("{p}", "{" + last.rstrip("s") + "}"), _full(cls, imports), action
        else:
            verbs = [w.upper() for w in _words(args[0])] if verb == "match" and args else [verb.upper()] if verb in VERBS else []
            rest = args[1:] if verb == "match" else args
            uri, target = (T.string_of(rest[0]), _action(rest[1])) if len(rest) > 1 else (None, None)
            if uri is not None and target and target[0] != "Closure":
                yield from ((path, v, uri, _full(target[0], imports), target[1]) for v in verbs)


def routes(files: DataFrame, structured: bool = False) -> DataFrame:
    """SRC11: (path, method, uri, controller, action) of route files."""
    read = structured_routes if structured else plain_routes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(p, c or "")], columns=list(_COLUMNS))

    return files.select("path", "content").mapInPandas(run, ROUTES)


# Functions that start a program.
STARTERS = frozenset("exec shell_exec system passthru proc_open".split())
SCRIPTS = "path string, line int, command string, script string"


def script_calls(files: DataFrame) -> DataFrame:
    """SRC12: Python scripts that are started from a string literal: (path, line, command, script)."""

    def read(path: str, text: str) -> Iterator[tuple]:
        ts = T.script(text)
        for k in range(len(ts) - 2):
            name, opening, arg = ts[k : k + 3]
            if name.kind == "name" and name.text.lstrip("\\").lower() in STARTERS and opening.text == "(" and arg.kind == "string":
                words = arg.text.split()
                runs = next((j for j, w in enumerate(words) if w.rpartition("/")[2].rstrip("0123456789.") == "python"), None)
                script = next((w for w in words[runs + 1 :] if not w.startswith("-")), "") if runs is not None else ""
                if script.endswith(".py"):
                    yield path, arg.line, arg.text, script

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(p, c or "")], columns=["path", "line", "command", "script"])

    return files.select("path", "content").mapInPandas(run, SCRIPTS)
