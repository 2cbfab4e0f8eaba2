"""A reader for the part of YAML that configuration files use: maps, lists, scalars, flow forms, block texts."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""^(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:\-\[\]{},&*!|>'"%@`][^:#]*?|-?[^\s:#,\[\]{}]+?)\s*:(?:\s+|$)""")


class _Lines:
    def __init__(self, text: str):
        self.rows: list[tuple[int, str]] = []
        self.raw = text.split("\n")
        self.at: list[int] = []
        for n, line in enumerate(self.raw):
            body = _uncommented(line).rstrip()
            if body.strip() and body.strip() not in ("---", "...") and not body.startswith("%"):
                self.rows.append((len(body) - len(body.lstrip()), body.strip()))
                self.at.append(n)
        self.k = 0

    def peek(self) -> tuple[int, str] | None:
        return self.rows[self.k] if self.k < len(self.rows) else None


def _uncommented(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[k - 1] == "\\") else quote
        elif c in "\"'" and (not k or line[k - 1] in " [{,:-("):
            quote = c
        elif c == "#" and (not k or line[k - 1].isspace()):
            return line[:k]
    return line


def scalar(text: str):
    """A plain or quoted scalar, or a flow list or map."""
    text = re.sub(r"^(?:[&!]\S+\s+)+", "", text.strip())
    if text[:1] in "[{" and text:
        return _flow(text)
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    low = text.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?\d*\.\d+(?:[eE][-+]?\d+)?", text):
        return float(text)
    return text


def _flow(text: str):
    inner, parts, depth, start, quote = text[1:-1], [], 0, 0, ""
    for k, c in enumerate(inner):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(inner[start:k])
            start = k + 1
    parts = [p.strip() for p in [*parts, inner[start:]] if p.strip()]
    if text[0] == "[":
        return [scalar(p) for p in parts]
    pairs = (re.match(r"""\s*("[^"]*"|'[^']*'|[^:]+?)\s*(?::\s*(.*))?$""", p, re.S) for p in parts)
    return {str(scalar(m[1])): scalar(m[2] or "") for m in pairs if m}


def _value(lines: _Lines, indent: int, text: str):
    """The value after a key or a dash: on the same line, a block text, or the deeper lines below."""
    text = re.sub(r"^(?:[&!]\S+(?:\s+|$))+", "", text)
    if re.fullmatch(r"[|>][-+0-9]*", text):
        first, rows = lines.at[lines.k - 1] + 1, []
        n = first
        while n < len(lines.raw) and (not lines.raw[n].strip() or len(lines.raw[n]) - len(lines.raw[n].lstrip()) > indent):
            rows.append(lines.raw[n])
            n += 1
        while lines.k < len(lines.rows) and lines.at[lines.k] < n:
            lines.k += 1
        deep = min((len(r) - len(r.lstrip()) for r in rows if r.strip()), default=0)
        body = [r[deep:] for r in rows]
        return "\n".join(body).rstrip("\n") if text[0] == "|" else " ".join(r.strip() for r in body if r.strip())
    if text:
        while text[0] in "[{" and text.count("[") + text.count("{") > text.count("]") + text.count("}") and lines.peek():
            text += " " + lines.peek()[1]
            lines.k += 1
        return scalar(text)
    below = lines.peek()
    if below and (below[0] > indent or (below[0] == indent and below[1].startswith("- "))):
        return _block(lines, below[0])
    return None


def _block(lines: _Lines, indent: int):
    first = lines.peek()[1]
    if first == "-" or first.startswith("- "):
        out = []
        while (row := lines.peek()) and row[0] == indent and (row[1] == "-" or row[1].startswith("- ")):
            body = row[1][1:].lstrip()
            inner = indent + len(row[1]) - len(body)
            if _KEY.match(body):  # a map begins on the dash's line
                lines.rows[lines.k] = (inner, body)
                out.append(_block(lines, inner))
            else:
                lines.k += 1
                out.append(_value(lines, indent, body))
        return out
    found = {}
    while (row := lines.peek()) and row[0] == indent and (m := _KEY.match(row[1])):
        lines.k += 1
        value = _value(lines, indent, row[1][m.end() :])
        key = str(scalar(m["key"]))
        if key == "<<":
            found = {**(value if isinstance(value, dict) else {}), **found}
        else:
            found[key] = value
    if not found:
        lines.k += 1
        return scalar(first)
    while (row := lines.peek()) and row[0] > indent:  # lines that belong to nothing
        lines.k += 1
    return found


def load(text: str):
    """The document as dicts, lists and scalars; null if there is nothing."""
    lines = _Lines(text.replace("\t", "  ").replace("\r", ""))
    return _block(lines, lines.peek()[0]) if lines.peek() else None
