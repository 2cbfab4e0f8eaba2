"""Composed containers, images, proxies and YAML contracts as rows (SRC15, SRC17, SRC18)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.sources import yaml_text
from graphloom.sources.text import OPERATIONS

_LISTS = ("image", "networks", "volumes", "env_files", "env_keys", "depends_on", "hosts", "ports")
COMPOSE = "name string, context string, " + ", ".join(f"{c} array<string>" for c in _LISTS) + ", source string"
PROXIES = "path string, server string, site string, kind string, target string, line int"
IMAGES = "path string, image string, stage string, ports array<string>, line int"
OPENAPI = "path string, method string, endpoint string, summary string"


def _table(files: DataFrame, read: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(p, c or "")], columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def _strings(value) -> list[str]:
    """A list, the keys of a map, or one scalar, as texts."""
    if value is None:
        return []
    if isinstance(value, dict):
        return [str(k) for k in value]
    return [str(x.get("source") or x.get("path") or x.get("target") or "") if isinstance(x, dict) else str(x) for x in (value if isinstance(value, list) else [value])]


def compose_services(path: str, text: str) -> Iterator[tuple]:
    """Services of a compose file; of environments only the names are read, never the values."""
    root = yaml_text.load(text)
    services = root.get("services") if isinstance(root, dict) else None
    for name, body in (services if isinstance(services, dict) else {}).items():
        s = body if isinstance(body, dict) else {}
        build = s.get("build")
        context = build.get("context") if isinstance(build, dict) else build
        keys = [x.partition("=")[0] for x in _strings(s.get("environment"))]
        extra = s.get("extra_hosts")
        hosts = list(extra) if isinstance(extra, dict) else [re.split(r"[:=]", x)[0] for x in _strings(extra)]
        volumes = [x.partition(":")[0] for x in _strings(s.get("volumes"))]
        found = {"image": _strings(s.get("image")), "networks": _strings(s.get("networks")), "volumes": volumes, "env_files": _strings(s.get("env_file")), "env_keys": keys, "depends_on": _strings(s.get("depends_on")), "hosts": hosts, "ports": _strings(s.get("ports"))}
        yield name, None if context is None else str(context), *(found[c] for c in _LISTS), path


def compose(files: DataFrame) -> DataFrame:
    """SRC17: one row per composed service, in the form that infra_edges() takes."""
    return _table(files, compose_services, COMPOSE)


def dockerfile(path: str, text: str) -> Iterator[tuple]:
    """Images that a Dockerfile builds from, with the stage's name and exposed ports."""
    stages: list[list] = []
    joined = re.sub(r"\\\r?\n", " ", text)
    for number, line in enumerate(joined.split("\n"), 1):
        words = line.split()
        if words and words[0].upper() == "FROM" and len(words) > 1:
            rest = [w for w in words[1:] if not w.startswith("--")]
            name = rest[2] if len(rest) > 2 and rest[1].upper() == "AS" else None
            stages.append([path, rest[0], name, [], number])
        elif words and words[0].upper() == "EXPOSE" and stages:
            stages[-1][3] += words[1:]
    yield from (tuple(s) for s in stages)


def images(files: DataFrame) -> DataFrame:
    """SRC17: (path, image, stage, ports, line) of Dockerfiles."""
    return _table(files, dockerfile, IMAGES)


def _caddy(path: str, text: str) -> Iterator[tuple]:
    """Sites of a Caddyfile with what they pass on, serve or import; bodies of snippets count where they are imported."""
    snippets: dict[str, list[tuple]] = {}
    used: list[tuple] = []
    stack: list[str] = []
    sites: list[str] = []
    snippet = None
    for number, line in enumerate(text.split("\n"), 1):
        words = re.sub(r"(^|\s)#.*", "", line).split()
        if not words:
            continue
        opens, closes = words[-1] == "{", words[0] == "}"
        if closes:
            stack = stack[:-1]
            if not stack:
                sites, snippet = [], None
            continue
        if not stack and opens:
            head = " ".join(words[:-1])
            snippet = head[1:-1] if head.startswith("(") and head.endswith(")") else None
            sites = [] if snippet else [x for x in re.split(r"[,\s]+", head) if x]
        else:
            name, rest = words[0], [w for w in words[1:] if w != "{"]
            rows = []
            if name == "reverse_proxy":
                rows = [("proxies_to", w) for w in rest if not w.startswith(("/", "@", "*"))]
            elif name == "to" and stack and stack[-1] == "reverse_proxy":
                rows = [("proxies_to", w) for w in rest]
            elif name == "root":
                rows = [("serves", rest[-1])] if rest else []
            elif name == "import":
                rows = [("imports", w) for w in rest[:1]]
            elif name == "redir":
                rows = [("redirects_to", next((w for w in rest if not w.startswith("@")), ""))]
            for kind, target in rows:
                if snippet is not None:
                    snippets.setdefault(snippet, []).append((kind, target, number))
                used += [(site, kind, target, number) for site in sites]
        if opens:
            stack.append(words[0])
    for site, kind, target, number in used:
        yield path, "caddy", site, kind, target, number
        if kind == "imports":
            yield from ((path, "caddy", site, k, t, n) for k, t, n in snippets.get(target, []))


def _nginx(path: str, text: str) -> Iterator[tuple]:
    """Servers with their locations' targets; a name of an upstream block counts as its servers."""
    words = [(m[0], text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\"[^\"]*\"|'[^']*'|[{};]|[^\s{};]+", re.sub(r"#[^\n]*", "", text))]
    upstreams: dict[str, list[str]] = {}
    passed: list[tuple] = []
    blocks: list[list[str]] = []
    names: list[str] = []
    pending: list[tuple] = []
    sentence: list[str] = []
    for word, line in words:
        if word == "{":
            blocks.append(sentence)
            if sentence[:1] == ["server"]:
                names, pending = [], []
        elif word == "}":
            closed = blocks.pop() if blocks else []
            if closed[:1] == ["server"]:
                passed += [(n, *p) for n in names or ["_"] for p in pending]
        elif word == ";":
            inside = blocks[-1] if blocks else []
            if sentence[:1] == ["server_name"]:
                names = sentence[1:]
            elif sentence[:1] in (["proxy_pass"], ["fastcgi_pass"]) and len(sentence) > 1:
                pending.append(("proxies_to", sentence[1], line))
            elif sentence[:1] == ["root"] and len(sentence) > 1:
                pending.append(("serves", sentence[1], line))
            elif inside[:1] == ["upstream"] and sentence[:1] == ["server"] and len(sentence) > 1:
                upstreams.setdefault(inside[1], []).append(sentence[1])
        else:
            sentence.append(word)
            continue
        sentence = []
    for site, kind, target, line in passed:
        host = re.sub(r"^[a-z]+://", "", target).split("/")[0]
        for real in upstreams.get(host, [target]):
            yield path, "nginx", site, kind, real, line


def _apache(path: str, text: str) -> Iterator[tuple]:
    site = "_"
    for number, line in enumerate(text.split("\n"), 1):
        words = line.split()
        low = words[0].lower() if words else ""
        if low.startswith("<virtualhost"):
            site = "_"
        elif low in ("servername", "serveralias") and len(words) > 1:
            site = words[1] if low == "servername" else site
        elif low in ("proxypass", "proxypassmatch") and len(words) > 2:
            yield path, "apache", site, "proxies_to", words[2], number
        elif low == "documentroot" and len(words) > 1:
            yield path, "apache", site, "serves", words[1].strip('"'), number


def proxies(files: DataFrame) -> DataFrame:
    """SRC18: (path, server, site, kind, target, line) of Caddy, nginx and Apache files, told by name."""

    def read(path: str, text: str) -> Iterator[tuple]:
        name = path.rpartition("/")[2].lower()
        if name.startswith("caddyfile"):
            yield from _caddy(path, text)
        elif name in ("httpd.conf", "apache2.conf", ".htaccess") or "<virtualhost" in text.lower():
            yield from _apache(path, text)
        elif name.endswith(".conf"):
            yield from _nginx(path, text)

    return _table(files, read, PROXIES)


def contract_operations(path: str, text: str) -> Iterator[tuple]:
    """Operations of a contract in JSON or YAML; what cannot be read has none."""
    try:
        root = json.loads(text) if text.lstrip().startswith("{") else yaml_text.load(text)
    except ValueError:
        return
    paths = root.get("paths") if isinstance(root, dict) else None
    for endpoint, operations in (paths if isinstance(paths, dict) else {}).items():
        for verb, op in (operations if isinstance(operations, dict) else {}).items():
            if verb.lower() in OPERATIONS:
                said = op if isinstance(op, dict) else {}
                yield path, verb.upper(), endpoint, str(next((said[k] for k in ("summary", "description", "operationId") if said.get(k)), ""))


def contracts(files: DataFrame) -> DataFrame:
    """SRC15: (path, method, endpoint, summary) of contracts in either form."""
    return _table(files, contract_operations, OPENAPI)
