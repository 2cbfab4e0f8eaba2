"""PHP text as tokens, and the shapes that are read from them: calls, lists of arguments, names in use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, var, string, number, op, open (a tag), html
    text: str
    line: int


_PATTERN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*?(?=\n|\?>|\Z)|\#(?!\[)[^\n]*?(?=\n|\?>|\Z))
  | (?P<close>\?>)
  | (?P<heredoc><<<[ \t]*(?P<quote>["']?)(?P<label>[A-Za-z_]\w*)(?P=quote)\r?\n(?P<body>.*?)^[ \t]*(?P=label)\b)
  | (?P<string>'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`)
  | (?P<var>\$+[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
  | (?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)
  | (?P<number>\d[\w.]*)
  | (?P<op>\?->|->|::|=>|\?\?=?|&&|\|\||\.\.\.|[=!]==?|<=>|[<>+\-*/.%&|^]=|\+\+|--|\#\[|.)
    """,
    re.X | re.S | re.M,
)
_OPEN = re.compile(r"<\?(?:php\b|=)", re.I)


def tokens(text: str) -> list[Token]:
    """All tokens but white space and comments; text outside of the tags is html."""
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        tag = _OPEN.search(text, at)
        end = tag.start() if tag else len(text)
        if text[at:end].strip():
            out.append(Token("html", text[at:end], line))
        if not tag:
            break
        line += text.count("\n", at, tag.end())
        at = tag.end()
        while at < len(text):
            m = _PATTERN.match(text, at)
            kind = m.lastgroup if m.lastgroup not in ("quote", "label", "body") else "heredoc"
            if m["heredoc"] is not None:
                out.append(Token("string", m["body"], line))
            elif kind == "string":
                out.append(Token("string", unquoted(m[0]), line))
            elif kind in ("var", "name", "number", "op"):
                out.append(Token(kind, m[0], line))
            line += m[0].count("\n")
            at = m.end()
            if kind == "close":
                out.append(Token("op", ";", line))
                break
    return out


def script(text: str) -> list[Token]:
    """Tokens of code that may stand without its opening tag."""
    return tokens(text) if _OPEN.search(text) else tokens("<?php " + text)


def unquoted(text: str) -> str:
    return re.sub(r"\\([\\'\"$`])", r"\1", text[1:-1])


_PAIRS = {"(": ")", "[": "]", "{": "}", "#[": "]"}


def closing(ts: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at this place; the end if none does."""
    depth = 0
    for k in range(at, len(ts)):
        if ts[k].kind == "op":
            if ts[k].text in _PAIRS:
                depth += 1
            elif ts[k].text in (")", "]", "}"):
                depth -= 1
                if not depth:
                    return k
    return len(ts)


def parts(ts: list[Token], lo: int, hi: int, mark: str = ",") -> list[tuple[int, int]]:
    """Ranges between marks that stand outside of inner brackets; none if there is nothing."""
    out, depth, start = [], 0, lo
    for k in range(lo, hi):
        if ts[k].kind == "op":
            depth += (ts[k].text in _PAIRS) - (ts[k].text in (")", "]", "}"))
            if not depth and ts[k].text == mark:
                out.append((start, k))
                start = k + 1
    return [(a, b) for a, b in [*out, (start, hi)] if a < b]


def arguments(ts: list[Token], at: int) -> list[list[Token]]:
    """The arguments of the list that opens at this place."""
    return [ts[a:b] for a, b in parts(ts, at + 1, closing(ts, at))]


def uses(ts: list[Token]) -> Iterator[tuple[str, str, str]]:
    """(kind, alias, full name) of use statements outside of classes; kind is class, function or const."""
    inner: list[bool] = []  # for each open brace whether it is another one than a namespace's
    for k, t in enumerate(ts):
        if t.kind == "op" and t.text == "{":
            inner.append("namespace" not in (x.text.lower() for x in ts[max(0, k - 2) : k]))
        elif t.kind == "op" and t.text == "}" and inner:
            inner.pop()
        if not (t.kind == "name" and t.text.lower() == "use") or (k and ts[k - 1].text == ")") or any(inner):
            continue
        end = next((j for j in range(k, len(ts)) if ts[j].text == ";"), len(ts))
        kind, lo = "class", k + 1
        if lo < end and ts[lo].text.lower() in ("function", "const"):
            kind, lo = ts[lo].text.lower(), lo + 1
        brace = next((j for j in range(lo, end) if ts[j].text == "{"), None)
        prefix = "".join(x.text for x in ts[lo:brace]) if brace is not None else ""
        for a, b in parts(ts, brace + 1, closing(ts, brace)) if brace is not None else parts(ts, lo, end):
            words = [x.text for x in ts[a:b] if x.kind == "name"]
            own = kind
            if words and words[0].lower() in ("function", "const") and len(words) > 1:
                own, words = words[0].lower(), words[1:]
            if words:
                full = (prefix + words[0]).lstrip("\\")
                yield own, words[2] if len(words) > 2 and words[1].lower() == "as" else full.rpartition("\\")[2], full


class StaticCall(NamedTuple):
    target: str
    name: str
    args: list[list[Token]]
    at: int
    line: int


def static_calls(ts: list[Token], target: str | None = None) -> Iterator[StaticCall]:
    """Calls Target::name(...), of one target (by its last segment) or all."""
    for k in range(len(ts) - 3):
        a, b, c, d = ts[k : k + 4]
        if a.kind == "name" and b.text == "::" and c.kind == "name" and d.text == "(" and (target is None or a.text.rpartition("\\")[2] == target):
            yield StaticCall(a.text, c.text, arguments(ts, k + 3), k, a.line)


def string_of(arg: list[Token]) -> str | None:
    return arg[0].text if len(arg) == 1 and arg[0].kind == "string" else None


def class_of(arg: list[Token]) -> str | None:
    """X of an argument X::class."""
    return arg[0].text if len(arg) == 3 and arg[0].kind == "name" and arg[1].text == "::" and arg[2].text.lower() == "class" else None
