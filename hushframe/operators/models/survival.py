"""Survival analysis on event tables: one row for each group and time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...errors import DisclosureError
from ...plans.ordered import edges, running_sums
from ...plans.store import keep
from ..frame import PrivateColumn, PrivateFrame
from ..release import Released, rows
from . import dist
from .design import build
from .regression import COLUMNS, coefficient_rows, combine, inverse, solve


def event_table(frame: PrivateFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """grp, t, d (events), n (at risk), size (of the group); groups under the minimum are left out."""
    frame._need(duration, event, *([by] if by else []))
    frame._need_support()
    g = F.col(f"`{by}`").cast("string") if by else F.lit("all")
    t, e = F.col(f"`{duration}`").cast("double"), F.col(f"`{event}`").cast("double")
    df = frame._df.select(g.alias("grp"), t.alias("t"), e.alias("e")).where("grp is not null and t is not null and e is not null")
    cells = keep(df.groupBy("grp", "t").agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("c")), "times")
    sizes = cells.groupBy("grp").agg(F.sum("c").alias("size")).where(F.col("size") >= frame._policy.suppression.descriptive_n)
    at_risk = running_sums(cells, ["grp"], "t", {"n": "c"}, edges(cells, "t"), down=True)
    return at_risk.join(sizes, "grp").select("grp", "t", "d", "c", "n", "size")


def survival_curve(frame: PrivateFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """grp, t, n, s: the product-limit estimate."""
    table = keep(event_table(frame, duration, event, by), "at-risk")
    own = table.withColumn("l", F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0)).withColumn("z", (F.col("d") >= F.col("n")).cast("int"))
    summed = running_sums(own, ["grp"], "t", {"logs": "l", "ended": "z"}, edges(own, "t"))
    return summed.select("grp", "t", "d", "n", F.when(F.col("ended") > 0, F.lit(0.0)).otherwise(F.exp("logs")).alias("s"))


def released_curve(frame: PrivateFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """grp, t, s where enough are at risk."""
    return survival_curve(frame, duration, event, by).where(F.col("n") >= frame._policy.suppression.descriptive_n).select("grp", "t", F.col("s").alias("survival"))


def medians(frame: PrivateFrame, duration: str, event: str, by: str | None = None) -> dict[str, float | None]:
    k = frame._policy.suppression.descriptive_n
    found = survival_curve(frame, duration, event, by).where("s <= 0.5").groupBy("grp").agg(F.min(F.struct("t", "n")).alias("m")).collect()
    return {r["grp"]: (r["m"]["t"] if r["m"]["n"] >= k else None) for r in found}


def kaplan_meier(frame: PrivateFrame, duration: str, event: str, by: str | None = None) -> Released:
    audit = {"verb": "kaplan_meier", "min_n": frame._policy.suppression.descriptive_n, "median": medians(frame, duration, event, by)}
    return Released("table", audit, released_curve(frame, duration, event, by).orderBy("grp", "t"), ["grp"])


def logrank(frame: PrivateFrame, duration: str, event: str, by: str) -> Released:
    """Observed less expected events of all groups but one, and their covariance, in one aggregate."""
    table = event_table(frame, duration, event, by).select("grp", "t", "d", "c")
    groups = [r[0] for r in table.select("grp").distinct().orderBy("grp").limit(101).collect()]
    if not 2 <= len(groups) <= 100:
        raise DisclosureError("the test needs 2 to 100 groups of sufficient size")
    wide = table.groupBy("t").agg(*[F.coalesce(F.sum(F.when(F.col("grp") == g, F.col(c))), F.lit(0.0)).alias(f"{c}{i}") for i, g in enumerate(groups) for c in ("d", "c")])
    wide = running_sums(wide, [], "t", {f"n{i}": f"c{i}" for i in range(len(groups))}, edges(table, "t"), down=True)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(len(groups))), F.lit(0.0))
    d, n = total("d"), total("n")
    m = len(groups) - 1
    share = [F.col(f"n{i}") / n for i in range(len(groups))]
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    aggs = [F.sum(F.col(f"d{i}") - d * share[i]) for i in range(m)]
    aggs += [F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i in range(m) for j in range(m)]
    found = wide.agg(*aggs).first()
    o, v = np.array(found[:m], float), np.array(found[m:], float).reshape(m, m)
    chi = float(o @ solve(v, o))
    made = {"type": "test", "test": "logrank", "statistic": chi, "pvalue": dist.chi2_sf(chi, m), "df": m}
    return Released("table", {"verb": "logrank"}, made=made)


def rmst(frame: PrivateFrame, duration: str, event: str, t: float, by: str | None = None) -> Released:
    return Released("series", {"verb": "rmst", "min_n": frame._policy.suppression.descriptive_n}, rmst_table(frame, duration, event, t, by).orderBy("grp"), ["grp"], "rmst")


def rmst_table(frame: PrivateFrame, duration: str, event: str, t: float, by: str | None = None) -> DataFrame:
    """The area under each group's curve up to t."""
    curve = survival_curve(frame, duration, event, by)
    w = Window.partitionBy("grp").orderBy("t")
    upto = F.least(F.coalesce(F.lead("t").over(w), F.lit(float(t))), F.lit(float(t)))
    first = F.row_number().over(w) == 1
    area = F.greatest(upto - F.col("t"), F.lit(0.0)) * F.col("s") + F.when(first, F.least(F.col("t"), F.lit(float(t)))).otherwise(0.0)
    return curve.select("grp", area.alias("a")).groupBy("grp").agg(F.sum("a").alias("rmst"))


# ---------------------------------------------------------------- Cox and accelerated failure time

class Cox:
    """Proportional hazards with Efron's ties, by Newton's method. Risk-set sums are running sums
    over the table of times, which has one row for each distinct time."""

    def __init__(self, frame: PrivateFrame, duration: str, event: str, x: list[str]):
        frame._need(duration, event)
        d = build(frame, duration, [(c,) for c in x], intercept=True, extra=[event], drop_small=True)
        self.names, self.columns = d.names[1:], d.columns[1:]
        self.design, self.frame = d, frame
        if d.n < frame._policy.suppression.descriptive_n or not self.names:
            raise DisclosureError("too few rows, or no covariate")
        p = len(self.names)
        mid = d.df.agg(*[F.avg(c) for c in self.columns]).first()
        self.centre = [float(v) for v in mid]
        own = d.df.select(F.col(f"`{duration}`").cast("double").alias("t"), F.col(f"`{event}`").cast("double").alias("e"), *[(c - m).alias(f"x{i}") for i, (c, m) in enumerate(zip(self.columns, self.centre))])
        self.beta = np.zeros(p)
        self.edges = edges(own, "t")
        for _ in range(40):
            grad, info = self._derivatives(own, p)
            step = solve(info, grad)
            self.beta = self.beta + step
            if np.abs(step).max() < 1e-8:
                break
        if not np.isfinite(self.beta).all() or np.abs(self.beta).max() > 1e4:
            raise DisclosureError("the model does not converge")
        self.cov = inverse(info)

    def _derivatives(self, own: DataFrame, p: int):
        xs = [F.col(f"x{i}") for i in range(p)]
        r = F.exp(combine(xs, self.beta))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [("s", r)] + [(f"s{i}", r * xs[i]) for i in range(p)] + [(f"s{i}_{j}", r * xs[i] * xs[j]) for i, j in pairs]
        dead = F.col("e") > 0
        aggs = [F.sum("e").alias("d")] + [F.sum(F.when(dead, xs[i]).otherwise(0.0)).alias(f"o{i}") for i in range(p)]
        for name, c in sums:
            aggs += [F.sum(c).alias(name), F.sum(F.when(dead, c).otherwise(0.0)).alias("k" + name)]
        table = own.groupBy("t").agg(*aggs)
        risk = running_sums(table, [], "t", {"r" + n: n for n, _ in sums}, self.edges, down=True).where("d > 0")
        risk = risk.select("d", *[f"o{i}" for i in range(p)], *[F.col("r" + n).alias(n) for n, _ in sums], *["k" + n for n, _ in sums])
        tied = risk.select("*", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)).alias("l"))
        f = F.col("l") / F.col("d")
        left = lambda n: F.col(n) - f * F.col("k" + n)
        out = [F.sum(F.col(f"o{i}") / F.col("d") - left(f"s{i}") / left("s")) for i in range(p)]
        out += [F.sum(left(f"s{i}_{j}") / left("s") - left(f"s{i}") * left(f"s{j}") / (left("s") * left("s"))) for i, j in pairs]
        found = tied.agg(*out).first()
        info = np.zeros((p, p))
        for (i, j), v in zip(pairs, found[p:]):
            info[i, j] = info[j, i] = v
        return np.array(found[:p], float), info

    def summary_rows(self) -> Released:
        k = self.frame._policy.min_n
        data = coefficient_rows(self.names, self.beta, self.cov, self.design.support, k)
        made = rows([*COLUMNS, "hazard_ratio"], self.names, [[*r, None if r[0] is None else math.exp(r[0])] for r in data], {}).made
        return Released("model", {"verb": "cox", "min_n": k}, made=made)

    def log_hazard(self) -> PrivateColumn:
        return PrivateColumn(self.frame, combine([c - F.lit(m) for c, m in zip(self.columns, self.centre)], self.beta), "log_partial_hazard")


class Aft:
    """Weibull, log-normal and log-logistic accelerated failure time models by maximum likelihood.
    An iteration is one aggregate: gradient and information of (beta, log sigma)."""

    def __init__(self, frame: PrivateFrame, duration: str, event: str, x: list[str], family: str):
        frame._need(duration, event)
        d = build(frame, duration, [(c,) for c in x], extra=[event], drop_small=True)
        self.family, self.frame, self.design = family, frame, d
        if d.n < frame._policy.suppression.descriptive_n:
            raise DisclosureError("too few rows to fit this model")
        if d.df.agg(F.min(d.y)).first()[0] <= 0:
            raise DisclosureError("durations are above zero")
        p = len(d.columns)
        own = d.df.select(F.ln(d.y).alias("y"), (F.col(f"`{event}`").cast("double") > 0).cast("double").alias("e"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(d.columns)])
        mean, sd = own.agg(F.avg("y"), F.stddev_samp("y")).first()
        theta = np.zeros(p + 1)
        theta[0], theta[p] = mean, math.log(max(sd or 1.0, 1e-3))
        value, grad, info = self._at(own, theta, p)
        for _ in range(60):
            ridge, moved = 0.0, False
            for _ in range(12):
                try:
                    step = np.linalg.solve(info + ridge * np.eye(p + 1), grad)
                except np.linalg.LinAlgError:
                    step = grad
                step = step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
                new = self._at(own, theta + step, p)
                if math.isfinite(new[0]) and new[0] >= value - 1e-9:
                    moved = True
                    break
                ridge = max(ridge * 10, float(np.trace(np.abs(info))) / (p + 1) * 1e-3)
            if not moved:
                break
            done = new[0] - value < 1e-9 * max(1.0, abs(value))
            theta, (value, grad, info) = theta + step, new
            if done:
                break
        self.theta, self.cov, self.loglik = theta, inverse(info), value

    def _at(self, own: DataFrame, theta: np.ndarray, p: int):
        sigma = math.exp(theta[p])
        xs = [F.col(f"x{i}") for i in range(p)]
        z = (F.col("y") - combine(xs, theta[:p])) / F.lit(sigma)
        e = F.col("e")
        if self.family == "weibull":  # log f = z - exp z, log S = -exp z
            g, like, bend = F.exp(z), e * z - F.exp(z), F.exp(z)
            first = e - g  # derivative by z
        elif self.family == "loglogistic":
            u = 1 / (1 + F.exp(-z))
            soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
            like, first, bend = e * z - (1 + e) * soft, e - (1 + e) * u, (1 + e) * u * (1 - u)
        else:
            dens = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            surv = _normal_sf(z)
            mill = F.when(z > 6, z + 1 / z).otherwise(dens / F.greatest(surv, F.lit(1e-300)))
            log_s = F.when(z > 6, -z * z / 2 - F.ln(z) - 0.5 * math.log(2 * math.pi)).otherwise(F.ln(F.greatest(surv, F.lit(1e-300))))
            like = e * (-z * z / 2 - 0.5 * math.log(2 * math.pi)) + (1 - e) * log_s
            first, bend = -e * z - (1 - e) * mill, e + (1 - e) * mill * (mill - z)
        named = own.select(*xs, z.alias("z"), e.alias("e"), like.alias("l"), first.alias("f"), bend.alias("b"))
        z, f, b = F.col("z"), F.col("f"), F.col("b")
        aggs = [F.sum(F.col("l") - F.col("e") * F.lit(theta[p]))]
        aggs += [F.sum(-f * x) / sigma for x in xs] + [F.sum(-f * z - F.col("e"))]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        aggs += [F.sum(b * xs[i] * xs[j]) / sigma**2 for i, j in pairs]
        aggs += [F.sum((b * z - f) * x) / sigma for x in xs] + [F.sum(b * z * z - f * z)]
        found = [float(v) if v is not None else float("nan") for v in named.agg(*aggs).first()]
        grad = np.array(found[1 : p + 2])
        info = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, found[p + 2 :]):
            info[i, j] = info[j, i] = v
        tail = found[p + 2 + len(pairs) :]
        info[:p, p] = info[p, :p] = tail[:p]
        info[p, p] = tail[p]
        return found[0], grad, info

    def summary_rows(self) -> Released:
        names = [f"mu:{n}" for n in self.design.names] + ["log_sigma"]
        support = {f"mu:{n}": s for n, s in self.design.support.items()} | {"log_sigma": self.design.n}
        k = self.frame._policy.min_n
        made = rows(COLUMNS, names, coefficient_rows(names, self.theta, self.cov, support, k), {}).made
        return Released("model", {"verb": f"{self.family}_aft", "min_n": k}, made=made)


def _normal_sf(z):
    """The upper normal tail by a rational approximation of Mills' ratio's complement (absolute
    error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


# ---------------------------------------------------------------- fitters

class CoxPHFitter:
    def __init__(self, **_):
        self._fit = None

    def fit(self, df, duration_col, event_col, formula=None):
        if not isinstance(df, PrivateFrame):
            raise DisclosureError("a private frame is needed")
        x = [c for c in df._cols if c not in (duration_col, event_col)]
        self._fit = Cox(df, duration_col, event_col, x)
        return self

    def _need(self):
        if self._fit is None:
            raise DisclosureError("fit first")
        return self._fit

    @property
    def summary(self): return self._need().summary_rows()
    def print_summary(self): return self._need().summary_rows()
    def predict_log_partial_hazard(self, *_): return self._need().log_hazard()

    def predict_partial_hazard(self, *_):
        c = self._need().log_hazard()
        return PrivateColumn(c._frame, F.exp(c._expr), "partial_hazard")


class KaplanMeierFitter:
    def __init__(self, **_):
        self._args = None

    def fit(self, durations, event_observed, label=None):
        if not isinstance(durations, PrivateColumn) or not isinstance(event_observed, PrivateColumn):
            raise DisclosureError("private columns are needed")
        d, e = durations._plain(), event_observed._plain()
        frame = d._frame
        event = frame._align(e)
        made = PrivateFrame(frame._df.withColumns({"__t": d._expr, "__e": event}), frame._policy, ["__t", "__e"], support=frame._support)
        self._args = (made, "__t", "__e")
        return self

    def _need(self):
        if self._args is None:
            raise DisclosureError("fit first")
        return self._args

    @property
    def survival_function_(self): return kaplan_meier(*self._need())
    @property
    def median_survival_time_(self):
        from ..release import scalar

        return scalar(medians(*self._need()).get("all"), {"verb": "median_survival_time"})

    def plot(self):
        p = kaplan_meier(*self._need()).payload
        return Released("plot", {"verb": "kaplan_meier"}, made={"type": "chart", "kind": "line", "name": "survival", "x": [r[0] for r in p["data"]], "y": [r[1] for r in p["data"]]})

    plot_survival_function = plot

    def print_summary(self): return kaplan_meier(*self._need())


class _AftFitter:
    family = "weibull"

    def __init__(self, **_):
        self._fit = None

    def fit(self, df, duration_col, event_col):
        if not isinstance(df, PrivateFrame):
            raise DisclosureError("a private frame is needed")
        self._fit = Aft(df, duration_col, event_col, [c for c in df._cols if c not in (duration_col, event_col)], self.family)
        return self

    @property
    def summary(self):
        if self._fit is None:
            raise DisclosureError("fit first")
        return self._fit.summary_rows()

    def print_summary(self): return self.summary


class WeibullAFTFitter(_AftFitter):
    family = "weibull"


class LogNormalAFTFitter(_AftFitter):
    family = "lognormal"


class LogLogisticAFTFitter(_AftFitter):
    family = "loglogistic"


class Lifelines:
    CoxPHFitter, KaplanMeierFitter, WeibullAFTFitter = CoxPHFitter, KaplanMeierFitter, WeibullAFTFitter
    LogNormalAFTFitter, LogLogisticAFTFitter = LogNormalAFTFitter, LogLogisticAFTFitter
