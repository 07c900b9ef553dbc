"""run(): policy, gate, restricted run, mediation, result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .errors import DisclosureError, HushError, SandboxError, ValidationError
from .functions.namespaces import Np, Pd, schema_entry
from .gate import validate
from .operators.charts import render as render_chart
from .operators.frame import PrivateColumn, PrivateFrame, PrivateGroups, PrivateSeriesGroups
from .operators.models.regression import Model, Results, Smf
from .operators.release import Released
from .operators.verbs import Safe
from .policy import Level, Policy, Profile, Suppression, resolve_policy


@dataclass
class Result:
    ok: bool
    kind: str
    payload: Any = None
    audit: dict = field(default_factory=dict)
    error: dict | None = None
    catalog: list | None = None
    results: list | None = None

    def leaf(self) -> dict:
        return {"ok": self.ok, "kind": self.kind, "payload": self.payload, "audit": self.audit, "error": self.error}

    def as_dict(self) -> dict:
        return {**self.leaf(), "catalog": self.catalog, "results": None if self.results is None else [r.leaf() for r in self.results]}


GUIDANCE = {
    PrivateFrame: "a private frame cannot be shown; release an aggregate of it",
    PrivateColumn: "a private column cannot be shown; release a statistic of it",
    PrivateGroups: "groups cannot be shown; choose a column and a statistic",
    PrivateSeriesGroups: "groups cannot be shown; choose a statistic",
    Results: "a fitted model cannot be shown; ask for its summary()",
    Model: "fit() the model and ask for its summary()",
}


def mediate(value, form: str = "spec") -> Released:
    """Only what a releasing verb made passes; everything else is refused."""
    if isinstance(value, Released):
        p = value.payload
        if isinstance(p, dict) and p.get("type") == "chart" and form != "spec":
            return Released(value.kind, value.audit, made={"type": "rendered", "form": form, "data": render_chart(p, form)})
        return value
    if value is None:
        raise DisclosureError("the expression has no value")
    for kind, message in GUIDANCE.items():
        if isinstance(value, kind):
            raise DisclosureError(message)
    raise DisclosureError("only released aggregates can leave")


def run(code: str, sources: dict[str, DataFrame], level: Level | str | list = Level.PROTECTED, *, profile: Profile | str | None = None,
        suppression: Suppression | str | None = None, render: str = "spec", keys: dict[str, list[str]] | None = None, catalog: bool = True) -> Result:
    """Run a script against private sources (name to Spark DataFrame) and give back suppressed
    aggregates only. ``keys`` may name columns that identify a source's rows."""
    policy: Policy = resolve_policy(level, suppression=suppression)
    stamp = {"level": policy.level.value, "profile": Profile(profile or policy.profile).value}
    names = {"safe": Safe(policy), "pd": Pd(), "np": Np(), "smf": Smf()}
    for name, df in sources.items():
        if not name.isidentifier() or name.startswith("_") or name in names:
            raise ValueError(f"unusable source name: {name!r}")
        names[name] = PrivateFrame.bind(df, policy, (keys or {}).get(name))
    gate = validate(code, names=frozenset(names))
    if not gate.ok:
        return _failed(gate.error, stamp)
    script, error = _told("script", lambda: _evaluator(names).run(code))
    if error:
        return _failed(error, stamp)
    stamp["verbs_used"] = gate.calls
    results = []
    for value in script.values:
        cleared, error = _told("result", lambda: _cleared(mediate(value, render), stamp))  # noqa: B023
        results.append(_failed(error, stamp) if error else cleared)
    good = [r for r in results if r.ok]
    last = results[-1] if results else Result(True, "none", audit=dict(stamp))
    last = Result(last.ok, last.kind, last.payload, last.audit, last.error)
    last.results = good
    if catalog:
        last.catalog, error = _told("catalog", lambda: [schema_entry(n, v) for n, v in script.names.items() if isinstance(v, PrivateFrame)])
        if error:
            return _failed(error, stamp)
    return last


def _evaluator(names: dict):
    from .sandbox import Evaluator

    return Evaluator(names)


def _told(what: str, make: Callable[[], Any]) -> tuple[Any, HushError | None]:
    """What ``make`` gives, or the error to tell. Of a foreign error only the class is told, because
    messages can hold data. An interrupt of the program is none of the script's and passes."""
    try:
        return make(), None
    except HushError as e:
        return None, e
    except (Exception, SystemExit) as e:
        return None, SandboxError(f"the {what} raised {type(e).__name__}")


def _cleared(r: Released, stamp: dict) -> Result:
    return Result(True, r.kind, r.payload, {**r.audit, **stamp})


def _failed(e: HushError, stamp: dict) -> Result:
    detail = e.as_dict() if isinstance(e, ValidationError) else {"kind": "disclosure" if isinstance(e, DisclosureError) else "runtime", "message": str(e)}
    return Result(False, "error", None, dict(stamp), detail)
