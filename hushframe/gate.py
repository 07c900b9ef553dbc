"""The static gate: a script is a flat run of simple assignments, imports and expressions.

Every syntax node is denied unless listed, so new syntax cannot slip in; names that dump rows, run
callables, or reach the engine below are denied wherever they stand.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from .errors import ValidationError

# The accepted syntax.
NODES = frozenset({
    ast.Module, ast.Expr, ast.Assign, ast.Import, ast.ImportFrom, ast.alias, ast.Name, ast.Load, ast.Store, ast.Constant, ast.List, ast.Tuple, ast.Dict,
    ast.Set, ast.Attribute, ast.Subscript, ast.Call, ast.keyword, ast.BoolOp, ast.And, ast.Or, ast.BinOp, ast.UnaryOp, ast.Not, ast.Invert, ast.UAdd,
    ast.USub, ast.Compare, ast.IfExp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Pow, ast.FloorDiv, ast.BitAnd, ast.BitOr, ast.BitXor, ast.LShift,
    ast.RShift, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.Is, ast.IsNot, ast.In, ast.NotIn,
})

# Modules that scripts may import (they get facades), and functions called by name.
MODULES = frozenset({"lifelines", "numpy", "pandas", "pyfixest"})
BUILTINS = frozenset({"abs", "bool", "float", "int", "len", "round", "str"})

# Denied attributes. Rows and exports; single rows by position or order; callables and
# little languages; ranks (rank and filter give differences); styling; the engine's own doors.
DENIED = frozenset({
    "head", "tail", "sample", "iloc", "loc", "at", "iat", "xs", "lookup", "iterrows", "itertuples", "items", "iteritems", "get", "pop", "squeeze",
    "to_csv", "to_dict", "to_json", "to_numpy", "to_records", "to_list", "tolist", "to_clipboard", "to_pickle", "to_parquet",
    "to_feather", "to_excel", "to_string", "to_markdown", "to_latex", "to_html", "values", "array", "item", "info", "memory_usage",
    "glimpse", "row", "rows", "get_column", "write_csv", "write_parquet",
    "idxmax", "idxmin", "argmax", "argmin", "nlargest", "nsmallest", "first", "last", "nth", "mode",
    "rank",
    "apply", "applymap", "pipe", "query", "eval", "rolling", "expanding", "ewm",
    "style",
    "format", "format_map", "rdd", "collect", "toPandas", "show", "write", "writeTo", "writeStream", "sql", "selectExpr", "expr", "toJSON",
    "foreach", "foreachPartition", "mapInPandas", "mapInArrow", "explain", "sparkSession", "sparkContext", "take", "takeAsList",
    "toLocalIterator", "checkpoint", "localCheckpoint", "cache", "persist", "createOrReplaceTempView",
})

# Names that may not be called.
FORBIDDEN = frozenset({
    "eval", "exec", "compile", "open", "input", "__import__", "getattr", "setattr", "delattr", "hasattr", "vars", "globals", "locals", "dir",
    "type", "object", "super", "memoryview", "breakpoint", "exit", "quit", "help", "id", "format",
})


@dataclass
class GateResult:
    ok: bool
    assigned: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    error: ValidationError | None = None


class _Refused(Exception):
    pass


class _Gate:
    def __init__(self, names: frozenset[str], imports: bool):
        self.known, self.imports = set(names) | BUILTINS, imports
        self.result = GateResult(True)

    def refuse(self, node, kind: str, message: str, token: str | None = None):
        self.result.ok = False
        self.result.error = ValidationError(message, kind=kind, line=getattr(node, "lineno", None), token=token)
        raise _Refused

    def private(self, node, name: str, kind: str):
        if name.startswith("_"):
            self.refuse(node, kind, f"names that begin with '_' are not allowed: {name}", name)

    def statement(self, node):
        if isinstance(node, ast.Assign):
            if len(node.targets) != 1 or not isinstance(node.targets[0], ast.Name):
                self.refuse(node, "structure", "an assignment binds one plain name")
            self.private(node, node.targets[0].id, "name")
            self.result.assigned.append(node.targets[0].id)
        elif not isinstance(node, (ast.Expr, ast.Import, ast.ImportFrom)):
            self.refuse(node, "structure", f"{type(node).__name__} is not allowed; use assignments and expressions")

    def node(self, node):
        if type(node) not in NODES:
            self.refuse(node, "syntax", f"{type(node).__name__} is not allowed")
        check = getattr(self, "on_" + type(node).__name__.lower(), None)
        if check:
            check(node)
        for child in ast.iter_child_nodes(node):
            self.node(child)

    def on_name(self, node):
        self.private(node, node.id, "name")

    def on_attribute(self, node):
        self.private(node, node.attr, "attribute")
        if node.attr in DENIED:
            self.refuse(node, "attribute", f"'{node.attr}' is not allowed: it can show single rows or run code", node.attr)

    def on_call(self, node):
        if isinstance(node.func, ast.Attribute):
            self.result.calls.append(node.func.attr)
        elif not isinstance(node.func, ast.Name):
            self.refuse(node, "call", "only name(...) and object.method(...) can be called")
        elif node.func.id in FORBIDDEN or node.func.id not in self.known:
            self.refuse(node, "call", f"'{node.func.id}' cannot be called", node.func.id)

    def on_subscript(self, node):
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, int):
            self.refuse(node, "subscript", "rows cannot be chosen by position; use a column name or a mask")

    def _module(self, node, module: str):
        if not self.imports:
            self.refuse(node, "import", "imports are not allowed here")
        if module.split(".")[0] not in MODULES:
            self.refuse(node, "import", f"module '{module}' is not available", module)

    def on_import(self, node):
        for a in node.names:
            self._module(node, a.name)
            self.known.add(a.asname or a.name.split(".")[0])

    def on_importfrom(self, node):
        self._module(node, node.module or "")
        self.known.update(a.asname or a.name for a in node.names)

    def on_alias(self, node):
        if node.name == "*" or (node.asname or "").startswith("_") or node.name.startswith("_"):
            self.refuse(node, "import", "import names one by one")


def validate(code: str, *, names: frozenset[str], imports: bool = True) -> GateResult:
    """Check a script without running anything."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return GateResult(False, error=ValidationError(f"could not parse: {getattr(e, 'msg', 'bad input')}", kind="parse", line=getattr(e, "lineno", None)))
    gate = _Gate(names, imports)
    try:
        if not tree.body:
            gate.refuse(tree, "empty", "empty script")
        for statement in tree.body:
            gate.statement(statement)
        gate.node(tree)
    except (_Refused, RecursionError):
        if gate.result.ok:
            gate.result = GateResult(False, error=ValidationError("the script nests too deeply", kind="syntax"))
    return gate.result
