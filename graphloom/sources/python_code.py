"""Python files by their syntax tree: nodes, edges, findings and branch counts (SRC6, BG6-BG10, A8).

A file that Python cannot parse gives no rows.
"""

from __future__ import annotations

import ast

# Names of HTTP verbs that routers have methods for.
VERBS = frozenset("get post put delete patch head options".split())
#: Calls whose outcome must be looked at.
PROCESS_CALLS = frozenset({("os", "system"), ("subprocess", "run"), ("subprocess", "call"), ("subprocess", "Popen")})

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def module_of(path: str) -> str:
    return path.removesuffix(".py").strip("/").replace("/", ".")


def _dotted(node: ast.expr) -> tuple[str, ...]:
    """The names of a.b.c; empty for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return (node.id, *reversed(names)) if isinstance(node, ast.Name) else ()


def _text(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def entry_of(decorator: ast.expr) -> dict | None:
    """What a decorator says about the function below it: a route, a command or a task."""
    call = decorator if isinstance(decorator, ast.Call) else None
    name = _dotted(call.func if call else decorator)
    if not name:
        return None
    path = _text(call.args[0]) if call and call.args else None
    last = name[-1].lower()
    if len(name) > 1 and path is not None and last in VERBS:
        return {"entrypoint_type": "http", "http_method": last.upper(), "http_path": path}
    if len(name) > 1 and path is not None and last == "route":
        given = next((k.value for k in call.keywords if k.arg == "methods"), None)
        verbs = [v.upper() for x in getattr(given, "elts", []) if (v := _text(x))]
        return {"entrypoint_type": "http", "http_method": ",".join(verbs or ["GET"]), "http_path": path}
    if name[0] == "click" and last in ("command", "group"):
        return {"entrypoint_type": "cli", "framework": "click"}
    if len(name) > 1 and last == "command":
        return {"entrypoint_type": "cli", "framework": "typer"}
    if name == ("shared_task",) or (len(name) > 1 and last == "task"):
        return {"entrypoint_type": "async", "framework": "celery"}
    return None


def cyclomatic(node: ast.AST) -> int:
    """1 + branch points; a chain of and/or counts once for each operator."""
    total = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
    return total


def _is_main(node: ast.stmt) -> bool:
    if not (isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and len(node.test.ops) == 1 and isinstance(node.test.ops[0], ast.Eq)):
        return False
    sides = [node.test.left, node.test.comparators[0]]
    return any(_dotted(x) == ("__name__",) for x in sides) and any(_text(x) == "__main__" for x in sides)


class _File:
    """Nodes, calls and imports of one file."""

    def __init__(self, path: str):
        self.path, self.module = path, module_of(path)
        self.nodes: list[dict] = []
        self.calls: list[tuple[str, str, int, int]] = []
        self.imports: dict[str, str] = {}

    def node(self, at: ast.AST, cls: str | None, name: str, entry: dict | None) -> str:
        owner = f"python:{self.module}{'.' + cls if cls else ''}::{name}"
        self.nodes.append({"kind": "node", "path": self.path, "line": at.lineno, "class": f"{self.module}.{cls}" if cls else self.module, "method": name, "src": owner, **(entry or {})})
        return owner

    def read(self, body: list[ast.stmt], cls: str | None = None) -> None:
        """Statements of the module or of one of its classes."""
        for x in body:
            if isinstance(x, _FUNCTIONS):
                entries = [e for d in x.decorator_list if (e := entry_of(d))]
                self.inside(x, self.node(x, cls, x.name, entries[-1] if entries else None))
            elif isinstance(x, ast.ClassDef):
                if cls is None:  # a class inside a class is left out
                    self.read(x.body, x.name)
            elif cls is None and _is_main(x):
                self.inside(x, self.node(x, None, "__main__", {"entrypoint_type": "script"}))
            else:
                self._imported(x)
                for name in ("body", "orelse", "finalbody"):
                    self.read([y for y in getattr(x, name, []) if isinstance(y, ast.stmt)], cls)
                for handler in getattr(x, "handlers", []):
                    self.read(handler.body, cls)

    def inside(self, node: ast.AST, owner: str) -> None:
        """Calls in a function's body count for it, those of functions inside it too."""
        body = node.body + getattr(node, "orelse", [])
        for x in (y for stmt in body for y in ast.walk(stmt)):
            self._imported(x)
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                if name:
                    self.calls.append((owner, name, x.lineno, x.col_offset))

    def _imported(self, x: ast.AST) -> None:
        if isinstance(x, ast.ImportFrom) and x.module:
            self.imports |= {a.asname or a.name: x.module for a in x.names}
        elif isinstance(x, ast.Import):
            self.imports |= {a.asname or a.name: a.name for a in x.names}

    def rows(self) -> list[dict]:
        own = {n["method"]: n["src"] for n in self.nodes if n["class"] == self.module}
        edges = []
        for src, name, line, _ in sorted(self.calls, key=lambda c: c[2:]):
            target = (own[name], "py_call") if name in own else (f"{self.imports[name]}::{name}", "py_import_call") if name in self.imports else None
            if target:
                edges.append({"kind": "edge", "path": self.path, "line": line, "src": src, "dst": target[0], "method": name, "type": target[1]})
        return self.nodes + edges


def python_file(path: str, text: str) -> list[dict]:
    """SRC6: functions, methods and the main block with their decorators; calls to functions of the file or imported ones."""
    tree = _tree(text)
    if tree is None:
        return []
    file = _File(path)
    file.read(tree.body)
    return file.rows()


def python_complexities(path: str, text: str) -> list[dict]:
    """(path, node_id, cyclomatic) of every function of the module and of its classes."""
    tree, module = _tree(text), module_of(path)
    if tree is None:
        return []
    owners = [(None, tree.body), *((x.name, x.body) for x in tree.body if isinstance(x, ast.ClassDef))]
    return [{"path": path, "node_id": f"python:{module}{'.' + cls if cls else ''}::{x.name}", "cyclomatic": cyclomatic(x)} for cls, body in owners for x in body if isinstance(x, _FUNCTIONS)]


def _does_nothing(body: list[ast.stmt]) -> bool:
    return all(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...) for x in body)


def python_bugs(path: str, text: str) -> list[dict]:
    """BG6-BG10: mutable defaults, missing return types, swallowed exceptions and unchecked processes, by innermost function."""
    tree, module, out = _tree(text), module_of(path), []
    if tree is None:
        return out

    def add(name: str, kind: str, confidence: float, line: int) -> None:
        out.append({"path": path, "node_id": f"python:{module}::{name}", "type": kind, "confidence": confidence, "line": line})

    def visit(node: ast.AST, name: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, _FUNCTIONS):
                if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*x.args.defaults, *x.args.kw_defaults]):
                    add(x.name, "python_mutable_default", 0.95, x.lineno)
                if isinstance(x, ast.FunctionDef) and not x.name.startswith("_") and x.returns is None:
                    add(x.name, "python_missing_return_type", 0.40, x.lineno)
                visit(x, x.name)
                continue
            if isinstance(x, ast.ExceptHandler) and _does_nothing(x.body):
                add(name, "python_exception_swallowing", 0.85, x.lineno)
            if isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) and _dotted(x.value.func)[-2:] in PROCESS_CALLS:
                add(name, "python_unchecked_subprocess", 0.75, x.lineno)
            visit(x, name)

    visit(tree, "module")
    return sorted(out, key=lambda r: (r["line"], r["type"]))
