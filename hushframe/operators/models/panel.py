"""Fixed-effects regression, Poisson with fixed effects, and instrumental variables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...errors import DisclosureError
from ...plans.store import keep
from ..frame import PrivateColumn, PrivateFrame
from ..release import Released, rows
from . import dist
from .design import Formula, build, parse
from .regression import COLUMNS, combine, gram, inverse, solve

VCOV = ("iid", "hetero", "HC1", "HC2", "HC3")


def demean(df: DataFrame, names: list[str], effects: list[str], weight: str | None = None, rounds: int = 1000) -> DataFrame:
    """Take group means away, effect after effect, until they no longer change. One effect needs
    one pass; after each pass over several, the table is written to cut the plan."""
    if not effects:
        return df
    w = F.col(weight) if weight else F.lit(1.0)
    for _ in range(1 if len(effects) == 1 else rounds):
        for e in effects:
            means = df.groupBy(e).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"m_{c}") for c in names])
            df = df.join(means, e).select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names], *[c for c in df.columns if c not in names])
        if len(effects) > 1:
            df = keep(df, "demeaned")
            first = df.groupBy(effects[0]).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in names])
            worst = first.agg(*[F.max(F.abs(F.col(c))) for c in names]).first()
            if max(v or 0.0 for v in worst) < 1e-9:
                return df
    if len(effects) > 1:
        raise DisclosureError("the effects could not be absorbed: the means do not settle")
    return df


class FeResults:
    """A fitted model with absorbed effects."""

    def __init__(self, frame, names, beta, cov, support, n, df_resid, columns, verb):
        self._frame, self._names, self._beta, self._cov = frame, names, beta, cov
        self._support, self._n, self._df, self._columns, self._verb = support, n, df_resid, columns, verb

    def summary(self) -> Released:
        from .regression import coefficient_rows

        k = self._frame._policy.min_n
        made = rows(COLUMNS, self._names, coefficient_rows(self._names, self._beta, self._cov, self._support, k, self._df), {}).made
        return Released("model", {"verb": self._verb, "min_n": k}, made=made)

    tidy = summary

    def predict(self) -> PrivateColumn:
        return PrivateColumn(self._frame, combine(self._columns, self._beta), "predicted")

    def __getattr__(self, name):
        raise DisclosureError(f"'{name}' is not available on a fitted model")


def _vcov(vcov, frame: PrivateFrame) -> tuple[str, str | None]:
    if isinstance(vcov, str) and vcov in VCOV:
        return vcov, None
    if isinstance(vcov, dict) and len(vcov) == 1:
        kind, column = next(iter(vcov.items()))
        if kind in ("CRV1", "CRV3"):
            frame._need(column)
            return kind, column
    raise DisclosureError(f"vcov is one of {', '.join(VCOV)}, or CRV1 or CRV3 of a column")


def feols(frame: PrivateFrame, f: Formula, vcov="iid", weights=None) -> FeResults:
    """Least squares after absorbing the effects; two stages if there are instruments."""
    kind, cluster = _vcov(vcov, frame)
    effects = [c for group in f.fe for c in group]
    extra = [*effects, *f.endog, *f.instruments, *([cluster] if cluster else [])]
    d = build(frame, f.y, f.terms, intercept=not f.fe and f.intercept, extra=extra, drop_small=True)
    k_min = frame._policy.suppression.descriptive_n
    if d.n < max(k_min, len(d.names) + 2):
        raise DisclosureError("too few rows to fit this model")
    num = lambda c: frame._col(c)._numeric()._expr.cast("double")
    xs = list(zip(d.names, d.columns)) + [(c, num(c)) for c in f.endog]
    zs = [num(c) for c in f.instruments]
    if f.endog and len(zs) < len(f.endog):
        raise DisclosureError("too few instruments")
    p, q = len(xs), len(zs)
    if not p:
        raise DisclosureError("no regressor is left")
    named = [d.y.alias("__y"), *[c.cast("double").alias(f"__x{i}") for i, (_, c) in enumerate(xs)], *[c.alias(f"__z{i}") for i, c in enumerate(zs)]]
    keys = [F.concat_ws("^", *[F.col(f"`{c}`").cast("string") for c in g]).alias(f"__f{i}") for i, g in enumerate(f.fe)]
    work = d.df.select(*named, *keys, *([F.col(f"`{cluster}`").alias("__c")] if cluster else []))
    numbers = ["__y", *[f"__x{i}" for i in range(p)], *[f"__z{i}" for i in range(q)]]
    fes = [f"__f{i}" for i in range(len(f.fe))]
    levels = sum(work.agg(*[F.count_distinct(e) for e in fes]).first()) - (len(fes) - 1) if fes else 0
    work = demean(work, numbers, fes)
    if fes:
        work = keep(work, "within")
    g = gram(work, [F.col(c) for c in numbers])
    y, x, z = 0, slice(1, 1 + p), slice(1 + p, 1 + p + q)
    if f.endog:  # the exogenous regressors are instruments too
        exo = list(range(1, 1 + len(d.names))) + list(range(1 + p, 1 + p + q))
        pz = inverse(g[np.ix_(exo, exo)])
        hat = pz @ g[np.ix_(exo, range(1, 1 + p))]  # first stages
        a = g[np.ix_(range(1, 1 + p), exo)] @ hat
        beta = solve(a, hat.T @ g[exo, y])
        fitted = [sum((F.col(numbers[e]) * F.lit(float(hat[i, j])) for i, e in enumerate(exo)), F.lit(0.0)) for j in range(p)]
    else:
        a = g[x, x]
        beta = solve(a, g[x, y])
        fitted = [F.col(f"__x{i}") for i in range(p)]
    bread = inverse(a)
    resid = F.col("__y") - combine([F.col(f"__x{i}") for i in range(p)], beta)
    own = work.select(*[c.alias(f"h{i}") for i, c in enumerate(fitted)], resid.alias("u"), *(["__c"] if cluster else []))
    dof = d.n - p - levels
    if dof < 1:
        raise DisclosureError("too few rows to fit this model")
    h = [F.col(f"h{i}") for i in range(p)]
    if kind == "iid":
        rss = own.agg(F.sum(F.col("u") * F.col("u"))).first()[0]
        cov, df_resid = bread * rss / dof, dof
    elif cluster:
        scores = own.groupBy("__c").agg(*[F.sum(h[i] * F.col("u")).alias(f"s{i}") for i in range(p)])
        meat = gram(scores, [F.col(f"s{i}") for i in range(p)])
        groups = scores.count()
        if groups < 2:
            raise DisclosureError("too few clusters")
        # effects nested in the clusters do not count against the degrees of freedom
        fixed = 0 if any(cluster in grp for grp in f.fe) else levels
        cov = bread @ meat @ bread * groups / (groups - 1) * (d.n - 1) / max(1, d.n - p - fixed)
        df_resid = groups - 1
    else:
        u2 = F.col("u") * F.col("u")
        if kind in ("HC2", "HC3"):
            lever = sum((h[i] * h[j] * F.lit(float(bread[i, j])) for i in range(p) for j in range(p)), F.lit(0.0))
            u2 = u2 / F.pow(F.greatest(1 - lever, F.lit(1e-10)), 1.0 if kind == "HC2" else 2.0)
        meat = gram(own, h, u2)
        cov = bread @ meat @ bread * (d.n / dof if kind in ("hetero", "HC1") else 1.0)
        df_resid = dof
    support = d.support | {c: d.n for c in f.endog}
    return FeResults(frame, [n for n, _ in xs], beta, cov, support, d.n, df_resid, [c for _, c in xs], "iv" if f.endog else "feols")


def fepois(frame: PrivateFrame, f: Formula, vcov="iid") -> FeResults:
    """Poisson by reweighted least squares; each round absorbs the effects with its weights."""
    kind, cluster = _vcov(vcov, frame)
    effects = [c for group in f.fe for c in group]
    d = build(frame, f.y, f.terms, intercept=not f.fe and f.intercept, extra=[*effects, *([cluster] if cluster else [])], drop_small=True)
    if d.n < max(frame._policy.suppression.descriptive_n, len(d.names) + 2):
        raise DisclosureError("too few rows to fit this model")
    p = len(d.names)
    keys = [F.concat_ws("^", *[F.col(f"`{c}`").cast("string") for c in g]).alias(f"__f{i}") for i, g in enumerate(f.fe)]
    fes = [f"__f{i}" for i in range(len(f.fe))]
    base = d.df.select(d.y.alias("y"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(d.columns)], *keys, *([F.col(f"`{cluster}`").alias("__c")] if cluster else []))
    low, mean = base.agg(F.min("y"), F.avg("y")).first()
    if low < 0:
        raise DisclosureError("the outcome does not suit the model")
    for e in fes:  # an effect without any event says nothing
        alive = base.groupBy(e).agg(F.sum("y").alias("t")).where("t > 0").select(e)
        base = base.join(alive, e, "left_semi")
    base = keep(base.withColumn("eta", F.ln((F.col("y") + F.lit(float(mean))) / 2)).withColumn("rid", F.monotonically_increasing_id()), "fepois")
    beta, last = np.zeros(p), None
    for _ in range(30):
        mu = F.exp("eta")
        work = base.withColumn("w", mu).withColumn("z", F.col("eta") + (F.col("y") - mu) / mu)
        numbers = ["zt", *[f"t{i}" for i in range(p)]]
        work = work.withColumn("zt", F.col("z")).withColumns({f"t{i}": F.col(f"x{i}") for i in range(p)})
        work = keep(demean(work, numbers, fes, "w"), "weighted")
        g = gram(work, [F.col(c) for c in numbers], F.col("w"))
        beta = solve(g[1:, 1:], g[1:, 0])
        resid = F.col("zt") - combine([F.col(f"t{i}") for i in range(p)], beta)
        work = work.withColumn("u", resid)
        base = keep(work.select("rid", "y", *[f"x{i}" for i in range(p)], *fes, *(["__c"] if cluster else []), (F.col("z") - F.col("u")).alias("eta")), "fepois")
        if last is not None and np.abs(beta - last).max() < 1e-8:
            break
        last = beta
    bread = inverse(g[1:, 1:])
    t = [F.col(f"t{i}") * F.col("w") * F.col("u") for i in range(p)]
    if kind == "iid":
        cov = bread
    elif cluster:
        scores = work.groupBy("__c").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(t)])
        groups = scores.count()
        cov = bread @ gram(scores, [F.col(f"s{i}") for i in range(p)]) @ bread * groups / max(1, groups - 1)
    else:
        cov = bread @ gram(work, t) @ bread * d.n / max(1, d.n - p)
    return FeResults(frame, d.names, beta, cov, d.support, d.n, None, d.columns, "fepois")


def iv(frame: PrivateFrame, y: str, x: list[str], endog: list[str], instruments: list[str], fe: list[str] = (), cluster: str | None = None) -> FeResults:
    f = Formula(y, [(c,) for c in x], True, [(c,) for c in fe], list(endog), list(instruments))
    return feols(frame, f, {"CRV1": cluster} if cluster else "hetero")


class Pyfixest:
    """``pf.feols("y ~ x | f1 + f2", data=df, vcov=...)``"""

    def feols(self, fml, data, vcov="iid"):
        return feols(self._frame(data), parse(fml, panel=True), vcov)

    def fepois(self, fml, data, vcov="iid"):
        return fepois(self._frame(data), parse(fml, panel=True), vcov)

    @staticmethod
    def _frame(data) -> PrivateFrame:
        if not isinstance(data, PrivateFrame):
            raise DisclosureError("data is a private frame")
        return data

    def __getattr__(self, name):
        raise DisclosureError(f"'{name}' is not available")
