"""Running a script that passed the gate: compiled whole first, then a statement at a time."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator
from types import CodeType
from typing import Any

from .functions.namespaces import Np, Pd
from .gate import BUILTINS
from .operators.models.panel import Pyfixest
from .operators.models.survival import Lifelines

#: What import gives for the modules that a script may name.
MODULES = {"numpy": Np, "pandas": Pd, "pyfixest": Pyfixest, "lifelines": Lifelines}
NAME = "<script>"


def facade(name, globals=None, locals=None, fromlist=(), level=0):
    """What ``import`` calls: a private stand-in for a known module."""
    root, _, _ = name.partition(".")
    if root in MODULES:
        return MODULES[root]()
    raise ImportError(f"module '{root}' is not available")


def steps(script: str) -> Iterator[tuple[bool, CodeType]]:
    """For each statement whether it is a bare expression, and its code."""
    for node in ast.parse(script, NAME).body:
        bare = isinstance(node, ast.Expr)
        tree = ast.Expression(node.value) if bare else ast.Module([node], type_ignores=[])
        yield bare, compile(tree, NAME, "eval" if bare else "exec")


class Evaluator:
    """The names of a script and what its bare expressions gave so far."""

    def __init__(self, names: dict[str, Any], imports: bool = True):
        allowed = {n: getattr(builtins, n) for n in BUILTINS} | ({"__import__": facade} if imports else {})
        self.names = names | {"__builtins__": allowed}
        self.values: list[Any] = []

    def run(self, script: str) -> "Evaluator":
        """Errors of any kind leave as they are; who calls must not show their messages."""
        for bare, code in list(steps(script)):
            value = eval(code, self.names)  # the gate has seen the script; a statement has no value
            if bare:
                self.values.append(value)
        return self
