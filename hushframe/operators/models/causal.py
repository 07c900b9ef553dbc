"""Average treatment effects, their refutation, propensities, and synthetic controls."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...errors import DisclosureError
from ...plans.quantiles import quantiles
from ...plans.store import keep
from ..frame import PrivateColumn, PrivateFrame
from ..release import Released, clean
from . import dist
from .design import build
from .regression import combine, fit, gram, inverse, solve

METHODS = ("weighting", "matching", "stratification", "regression")


def _guard(frame: PrivateFrame, outcome: str | None, treatment: str, confounders: list[str]):
    d = build(frame, treatment, [(c,) for c in frame._names(confounders)], extra=[outcome] if outcome else [])
    low, high, n1, n = d.df.agg(F.min(d.y), F.max(d.y), F.sum(d.y), F.count(F.lit(1))).first()
    if low != 0 or high != 1 or d.df.where((d.y != 0) & (d.y != 1)).limit(1).count():
        raise DisclosureError("the treatment is 0 or 1")
    if min(n1, n - n1) < frame._policy.suppression.descriptive_n:
        raise DisclosureError("a treatment arm has too few rows")
    return d


def _effect(df: DataFrame, x: list, design, method: str) -> tuple[float, float]:
    """Effect and standard error. df: y, t, p (propensity), x0.. (design columns)."""
    y, t, p = F.col("y"), F.col("t"), F.col("p")
    if method == "regression":
        cols = [t, *x]
        g = gram(df, [*cols, y])
        k = len(cols)
        inv = inverse(g[:k, :k])
        beta = inv @ g[:k, k]
        n = df.count()
        return float(beta[0]), math.sqrt(max(0.0, inv[0, 0] * (g[k, k] - beta @ g[:k, k]) / (n - k)))
    if method == "weighting":
        w1, w0 = t / p, (1 - t) / (1 - p)
        s1, s0, m1, m0 = df.agg(F.sum(w1), F.sum(w0), F.sum(w1 * y), F.sum(w0 * y)).first()
        a, b = m1 / s1, m0 / s0
        v1, v0 = df.agg(F.sum(w1 * w1 * (y - F.lit(a)) ** 2), F.sum(w0 * w0 * (y - F.lit(b)) ** 2)).first()
        return a - b, math.sqrt(v1 / s1**2 + v0 / s0**2)
    if method == "stratification":
        edges = quantiles(df, {"p": p}, [i / 10 for i in range(1, 10)])["p"] or []
        bin_ = sum(((p > F.lit(e)).cast("int") for e in edges), F.lit(0))
        cells = df.groupBy(bin_.alias("b")).agg(*[f(F.when(t == v, y)) for v in (1, 0) for f in (F.count, F.avg, F.var_samp)]).collect()
        used = [r for r in cells if r[1] > 1 and r[4] > 1]
        total = sum(r[1] + r[4] for r in used)
        if not total:
            raise DisclosureError("the arms do not overlap")
        effect = sum((r[1] + r[4]) / total * (r[2] - r[5]) for r in used)
        return effect, math.sqrt(sum(((r[1] + r[4]) / total) ** 2 * (r[3] / r[1] + r[6] / r[4]) for r in used))
    if method == "matching":
        return _matched(df)
    raise DisclosureError(f"method is one of {', '.join(METHODS)}")


SLICES = 1000


def _matched(df: DataFrame) -> tuple[float, float]:
    """Nearest neighbour on the score, both ways. Scores are cut into fixed slices; within a slice
    the last and next row of the other arm come from windows, across slices from the slices' ends."""
    p, t = F.col("p"), F.col("t")
    rows = df.select("y", "t", "p", F.least(F.floor(p * SLICES), F.lit(SLICES - 1)).cast("int").alias("s"), F.monotonically_increasing_id().alias("id"))
    rows = keep(rows, "matching")
    pair = F.struct(p.alias("p"), F.col("y").alias("y"))
    up = Window.partitionBy("s").orderBy("p", "id").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("s").orderBy(F.desc("p"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("s").agg(*[f(F.when(t == v, pair)).alias(f"{n}{v}") for v in (0, 1) for n, f in (("low", F.min), ("high", F.max))])
    whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows
    back = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    around = ends.select("s", *[F.last(f"high{v}", True).over(whole).alias(f"before{v}") for v in (0, 1)], *[F.last(f"low{v}", True).over(back).alias(f"after{v}") for v in (0, 1)])
    near = rows.select("*", *[F.last(F.when(t == v, pair), True).over(up).alias(f"b{v}") for v in (0, 1)], *[F.last(F.when(t == v, pair), True).over(down).alias(f"a{v}") for v in (0, 1)])
    near = near.join(F.broadcast(around), "s")
    other = lambda n, m: F.when(t == 1, F.coalesce(F.col(f"{n}0"), F.col(f"{m}0"))).otherwise(F.coalesce(F.col(f"{n}1"), F.col(f"{m}1")))
    near = near.select("y", "t", "p", other("b", "before").alias("b"), other("a", "after").alias("a"))
    gap_b, gap_a = F.coalesce(p - F.col("b.p"), F.lit(9.0)), F.coalesce(F.col("a.p") - p, F.lit(9.0))
    mate = F.when(gap_b <= gap_a, F.col("b.y")).otherwise(F.col("a.y"))
    effect = F.when(t == 1, F.col("y") - mate).otherwise(mate - F.col("y"))
    n, mean, var = near.agg(F.count(F.lit(1)), F.avg(effect), F.var_samp(effect)).first()
    return mean, math.sqrt(2 * var / n)  # a row serves as a mate about once


def _prepared(frame, outcome, treatment, confounders):
    d = _guard(frame, outcome, treatment, confounders)
    model = fit(d, "logit")
    p = F.least(F.greatest(model._mean(), F.lit(0.01)), F.lit(0.99))
    y = frame._col(outcome)._numeric()._expr.cast("double")
    df = d.df.select(y.alias("y"), d.y.alias("t"), p.alias("p"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(d.columns)])
    return d, keep(df, "ate"), [F.col(f"x{i}") for i in range(len(d.columns))]


def _released(verb: str, effect: float, se: float, **more) -> Released:
    z = dist.z_crit()
    made = {"type": "effect", "effect": clean(effect), "std_err": clean(se), "ci_low": clean(effect - z * se), "ci_high": clean(effect + z * se), **more}
    return Released("table", {"verb": verb}, made=made)


def ate(frame: PrivateFrame, outcome: str, treatment: str, confounders: list[str], method: str = "weighting") -> Released:
    if method not in METHODS:
        raise DisclosureError(f"method is one of {', '.join(METHODS)}")
    d, df, x = _prepared(frame, outcome, treatment, confounders)
    return _released("ate", *_effect(df, x, d, method), method=method)


def refute_ate(frame: PrivateFrame, outcome: str, treatment: str, confounders: list[str], method: str = "regression", refuter: str = "placebo", seed: int = 7) -> Released:
    """Estimate again with a treatment drawn at random, one more random cause, or part of the rows."""
    d, df, x = _prepared(frame, outcome, treatment, confounders)
    first, _ = _effect(df, x, d, method)
    if refuter == "placebo":
        share = df.agg(F.avg("t")).first()[0]
        changed = df.withColumn("t", (F.rand(seed) < F.lit(share)).cast("double")).withColumn("p", F.lit(share))
    elif refuter == "random_common_cause":
        changed = df.withColumn("extra", F.randn(seed))
        x = [*x, F.col("extra")]
    elif refuter == "data_subset":
        changed = df.sample(0.8, seed)
    else:
        raise DisclosureError("refuter is placebo, random_common_cause or data_subset")
    again, se = _effect(keep(changed, "refute"), x, d, method)
    return _released("refute_ate", again, se, refuter=refuter, original=clean(first))


def propensity(frame: PrivateFrame, treatment: str, confounders: list[str]) -> PrivateColumn:
    return PrivateColumn(frame, fit(_guard(frame, None, treatment, confounders), "logit")._mean(), "propensity")


def simplex_fit(a: np.ndarray, b: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Weights at or above 0 that sum to 1 and bring a @ w nearest to b (accelerated projected
    gradient)."""
    w = np.full(a.shape[1], 1 / a.shape[1])
    size = np.linalg.norm(a, 2) ** 2 or 1.0
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        step = v - a.T @ (a @ v - b) / size
        u = np.sort(step)[::-1]
        c = np.cumsum(u) - 1
        k = np.nonzero(u > c / np.arange(1, len(u) + 1))[0][-1]
        new = np.maximum(step - c[k] / (k + 1), 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - w)
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w, t = new, nt
    return w


def synthetic_control(frame: PrivateFrame, unit: str, time: str, outcome: str, treated_unit, treatment_time, predictors=None, controls=None, unit_size: str | None = None, max_weight: float = 0.5) -> Released:
    """The gap between a unit and its weighted controls; weights are not shown."""
    frame._need(unit, time, outcome, *([unit_size] if unit_size else []), *(predictors or []))
    k, max_weight = frame._policy.min_n, min(float(max_weight), 0.5)
    known = frame._df.where(F.col(f"`{outcome}`").isNotNull())
    if controls is not None:
        known = known.where(F.col(f"`{unit}`").isin([treated_unit, *controls]))
    n_units = known.select(unit).distinct().limit(1001).count()
    if n_units > 1000:
        raise DisclosureError("more than 1000 units")
    aggs = [F.avg(F.col(f"`{outcome}`").cast("double")).alias("y"), F.count(F.lit(1)).alias("n")] + [F.avg(F.col(f"`{c}`").cast("double")).alias(f"p{i}") for i, c in enumerate(predictors or [])]
    cells = known.groupBy(unit, time).agg(*aggs, (F.min(unit_size) if unit_size else F.lit(None).cast("double")).alias("size"))
    cells = keep(cells, "cells")
    smallest, n_times = cells.agg(F.min("size")).first()[0], cells.select(time).distinct().count()
    # only units that are there at all times count, so the others' cells need not be fetched
    full = [r[0] for r in cells.groupBy(unit).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n_times).collect()]
    cells = cells.where(F.col(f"`{unit}`").isin([u for u in full if u is not None]) | (F.col(f"`{unit}`").isNull() & F.lit(None in full))).collect()
    times = sorted({r[time] for r in cells})
    units = sorted({r[unit] for r in cells} - {treated_unit}, key=str)
    value = {(r[unit], r[time]): r["y"] for r in cells}
    units = [u for u in units if all((u, t) in value for t in times)]
    pre, post = [t for t in times if t < treatment_time], [t for t in times if t >= treatment_time]
    if not all((treated_unit, t) in value for t in times):
        raise DisclosureError("the treated unit is not there at all times")
    if len(units) < 2 or len(pre) < 3 or not post:
        raise DisclosureError("two controls, three times before and one after are needed")
    a = np.array([[value[u, t] for u in units] for t in times])
    b = np.array([value[treated_unit, t] for t in times])
    fit_a, fit_b = a[: len(pre)], b[: len(pre)]
    for i, _ in enumerate(predictors or []):
        mean = lambda u: np.mean([r[f"p{i}"] for r in cells if r[unit] == u and r[time] < treatment_time and r[f"p{i}"] is not None] or [0.0])  # noqa: B023, E731
        row = np.array([mean(u) for u in units])
        scale = row.std() / (fit_a.std() or 1) or 1
        fit_a, fit_b = np.vstack([fit_a, row / scale]), np.append(fit_b, mean(treated_unit) / scale)
    centre, spread = fit_a.mean(), fit_a.std() or 1.0
    w = simplex_fit((fit_a - centre) / spread, (fit_b - centre) / spread)
    donors, top = float(1 / np.sum(w * w)), float(w.max())
    large = smallest is not None and smallest >= k
    if not large and not (donors >= k and top <= max_weight):
        raise DisclosureError("the synthetic unit rests on too few controls")
    gap = b - a @ w
    made = {"type": "effect", "att": clean(float(gap[len(pre):].mean())), "pre_rmspe": clean(float(np.sqrt(np.mean(gap[: len(pre)] ** 2)))), "effective_donors": round(donors, 1), "max_weight": round(top, 2), "times": [str(t) for t in times], "gap": [clean(float(v)) for v in gap]}
    return Released("table", {"verb": "synthetic_control"}, made=made)
