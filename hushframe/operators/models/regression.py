"""Linear, logistic and Poisson regression: sums of products on the executors, small solves here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...errors import DisclosureError
from ..frame import PrivateColumn, PrivateFrame
from ..release import Released, rows
from . import dist
from .design import Design, build, parse


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """All sums of products of some columns, in one aggregate."""
    p = len(columns)
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], (F.lit(1.0) if weight is None else weight).alias("w"))
    at = [(i, j) for i in range(p) for j in range(i, p)]
    found = named.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")) for i, j in at]).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(at, found):
        out[i, j] = out[j, i] = v or 0.0
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        raise DisclosureError("the design is singular; leave out a term") from None


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def combine(columns: list[Column], beta) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, beta):
        out = out + c * F.lit(float(b))
    return out


def coefficient_rows(names, beta, cov, support, k, df_resid=None) -> list[list]:
    """coef, std_err, ci_low, ci_high, pvalue; blank where too few rows stand behind a term."""
    crit = dist.t_crit(df_resid) if df_resid else dist.z_crit()
    out = []
    for i, name in enumerate(names):
        se = math.sqrt(max(cov[i, i], 0.0))
        z = beta[i] / se if se else float("inf")
        p = dist.t_sf2(z, df_resid) if df_resid else dist.normal_sf2(z)
        ok = support.get(name, 0) >= k
        out.append([float(beta[i]), se, float(beta[i] - crit * se), float(beta[i] + crit * se), p] if ok else [None] * 5)
    return out


COLUMNS = ["coef", "std_err", "ci_low", "ci_high", "pvalue"]


class Results:
    """A fitted model: ``summary``, ``margeff``, and private predictions and residuals."""

    def __init__(self, design: Design, family: str, beta: np.ndarray, cov: np.ndarray, extra: dict):
        self._d, self._family, self._beta, self._cov, self._extra = design, family, beta, cov, extra

    def summary(self) -> Released:
        d, k = self._d, self._d.frame._policy.min_n
        resid = d.n - len(d.names) if self._family == "ols" else None
        audit = {"verb": self._family, "min_n": k, "n_ok": True, **self._extra}
        return Released("model", audit, made=rows(COLUMNS, d.names, coefficient_rows(d.names, self._beta, self._cov, d.support, k, resid), {}).made)

    def print_summary(self) -> Released:
        return self.summary()

    def _mean(self) -> Column:
        eta = combine(self._d.columns, self._beta)
        return {"ols": eta, "logit": 1 / (1 + F.exp(-eta)), "poisson": F.exp(eta)}[self._family]

    def predict(self) -> PrivateColumn:
        return PrivateColumn(self._d.frame, self._mean(), "predicted")

    @property
    def fittedvalues(self) -> PrivateColumn:
        return self.predict()

    @property
    def resid(self) -> PrivateColumn:
        return PrivateColumn(self._d.frame, self._d.y - self._mean(), "residual")

    def margeff(self) -> Released:
        """Average marginal effects with delta-method errors."""
        if self._family == "ols":
            raise DisclosureError("margeff is for logit and poisson")
        d, mu = self._d, self._mean()
        slope, bend = (mu * (1 - mu), mu * (1 - mu) * (1 - 2 * mu)) if self._family == "logit" else (mu, mu)
        found = d.df.agg(F.avg(slope), *[F.avg(bend * c) for c in d.columns]).first()
        names, out = [], []
        for i, name in enumerate(d.names):
            if name == "Intercept":
                continue
            jac = np.array(found[1:], float) * self._beta[i]
            jac[i] += found[0]
            se = math.sqrt(max(float(jac @ self._cov @ jac), 0.0))
            effect = self._beta[i] * found[0]
            ok = d.support[name] >= d.frame._policy.min_n
            names.append(name)
            out.append([effect, se, effect - dist.z_crit() * se, effect + dist.z_crit() * se, dist.normal_sf2(effect / se) if se else 0.0] if ok else [None] * 5)
        return Released("model", {"verb": "margeff"}, made=rows(COLUMNS, names, out, {}).made)

    def __getattr__(self, name):
        raise DisclosureError(f"'{name}' is not available on a fitted model")


def check_size(design: Design) -> None:
    k = design.frame._policy.suppression.descriptive_n
    if design.n < max(k, len(design.names) + 1):
        raise DisclosureError("too few rows to fit this model")


def fit(design: Design, family: str) -> Results:
    check_size(design)
    p = len(design.columns)
    if family == "ols":
        g = gram(design.df, [*design.columns, design.y])
        inv = inverse(g[:p, :p])
        beta = inv @ g[:p, p]
        rss = g[p, p] - beta @ g[:p, p]
        return Results(design, family, beta, inv * rss / (design.n - p), {"r_squared": float(1 - rss / (g[p, p] - g[0, p] ** 2 / design.n)) if design.names[0] == "Intercept" else None})
    low, high = design.df.agg(F.min(design.y), F.max(design.y)).first()
    if family == "logit" and not (low == 0 and high == 1) or family == "poisson" and low < 0:
        raise DisclosureError("the outcome does not suit the model")
    beta = np.zeros(p)
    if family == "poisson" and design.names[0] == "Intercept":
        beta[0] = math.log(max(design.df.agg(F.avg(design.y)).first()[0], 1e-12))
    for _ in range(50):
        eta = combine(design.columns, beta)
        mu = 1 / (1 + F.exp(-eta)) if family == "logit" else F.exp(eta)
        w = mu * (1 - mu) if family == "logit" else mu
        named = design.df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(design.columns)], w.alias("w"), (design.y - mu).alias("r"))
        at = [(i, j) for i in range(p) for j in range(i, p)]
        found = named.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")) for i, j in at], *[F.sum(F.col(f"x{i}") * F.col("r")) for i in range(p)]).first()
        info = np.zeros((p, p))
        for (i, j), v in zip(at, found):
            info[i, j] = info[j, i] = v
        step = solve(info, np.array(found[len(at):], float))
        beta = beta + step
        if np.abs(step).max() < 1e-9 or not np.isfinite(beta).all():
            break
    if not np.isfinite(beta).all() or np.abs(beta).max() > 1e6:
        raise DisclosureError("the model does not converge")
    return Results(design, family, beta, inverse(info), {})


class Model:
    def __init__(self, formula: str, frame: PrivateFrame, family: str):
        self._f, self._frame, self._family = parse(formula), frame, family

    def fit(self, *_, **__) -> Results:
        return fit(build(self._frame, self._f.y, self._f.terms, self._f.intercept), self._family)


class Smf:
    """``smf.ols("y ~ a + C(b)", data=df).fit()``"""

    def _make(self, formula, data, family):
        if not isinstance(data, PrivateFrame):
            raise DisclosureError("data is a private frame")
        return Model(formula, data, family)

    def ols(self, formula, data): return self._make(formula, data, "ols")
    def logit(self, formula, data): return self._make(formula, data, "logit")
    def poisson(self, formula, data): return self._make(formula, data, "poisson")

    def __getattr__(self, name):
        raise DisclosureError(f"smf.{name} is not available")


def by_names(frame: PrivateFrame, y: str, x: list[str], family: str) -> Results:
    return fit(build(frame, y, [(c,) for c in frame._names(x)]), family)
