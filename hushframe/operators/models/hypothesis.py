"""Hypothesis tests from small aggregates; groups are never shown, only the test."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ...errors import DisclosureError
from ...plans.ordered import number, running
from ..frame import PrivateFrame
from ..release import Released
from . import dist


def _out(test: str, statistic: float, p: float, n: int, **more) -> Released:
    from ..release import clean

    made = {"type": "test", "test": test, "statistic": clean(statistic), "pvalue": clean(p), "n": n, **{k: clean(v) for k, v in more.items()}}
    return Released("table", {"verb": test}, made=made)


def _shown(frame, n: int) -> int:
    base = frame._policy.round_to
    return round(n / base) * base if base else n


def _two_groups(frame: PrivateFrame, value: str, by: str) -> list:
    frame._need(value, by)
    v = F.col(f"`{value}`").cast("double")
    rows = frame._df.where(v.isNotNull() & F.col(f"`{by}`").isNotNull()).groupBy(by).agg(F.count(v), F.avg(v), F.var_samp(v)).orderBy(by).limit(3).collect()
    if len(rows) != 2:
        raise DisclosureError("the test needs 2 groups")
    if any(r[1] < frame._policy.suppression.descriptive_n for r in rows):
        raise DisclosureError("a group has too few rows")
    return rows


def ttest(frame: PrivateFrame, value: str, by: str | None = None, mu: float = 0.0) -> Released:
    if by is None:
        v = frame._col(value)._numeric()._expr.cast("double")
        n, mean, var = frame._df.agg(F.count(v), F.avg(v), F.var_samp(v)).first()
        if n < frame._policy.suppression.descriptive_n or not var:
            raise DisclosureError("too few rows, or no variation")
        t = (mean - mu) / math.sqrt(var / n)
        return _out("ttest", t, dist.t_sf2(t, n - 1), _shown(frame, n), df=n - 1 if not frame._policy.round_to else None)
    (_, n1, m1, v1), (_, n2, m2, v2) = _two_groups(frame, value, by)
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        raise DisclosureError("there is no variation")
    t = (m1 - m2) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return _out("ttest", t, dist.t_sf2(t, df), _shown(frame, n1 + n2), df=df)


def anova(frame: PrivateFrame, value: str, by: str) -> Released:
    """The groups are summed where they are, however many there are."""
    frame._need(value, by)
    df = frame._df.select(F.col(f"`{value}`").cast("double").alias("v"), F.col(f"`{by}`").alias("g")).where("v is not null and g is not null")
    mean = df.agg(F.avg("v")).first()[0]
    groups = df.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    k, n, least, between, within = groups.agg(
        F.count(F.lit(1)), F.sum("n"), F.min("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.lit(mean), F.lit(2.0))), F.sum((F.col("n") - 1) * F.coalesce("s", F.lit(0.0))),
    ).first()
    if k < 2:
        raise DisclosureError("the test needs at least 2 groups")
    if least < frame._policy.suppression.descriptive_n:
        raise DisclosureError("a group has too few rows")
    if not within:
        raise DisclosureError("there is no variation")
    f = (between / (k - 1)) / (within / (n - k))
    return _out("anova", f, dist.f_sf(f, k - 1, n - k), _shown(frame, n), df_between=k - 1)


def ranks(df, value: str, out: str):
    """Average ranks by a table of value counts."""
    counts = number(df.groupBy(value).agg(F.count(F.lit(1)).alias("__c")), [F.col(value)], "__b", "__p")
    summed = running(counts, "__b", "__p", "__c", "__upto", "sum")
    return summed.select(value, (F.col("__upto") - (F.col("__c") - 1) / 2.0).alias(out), "__c")


def mannwhitney(frame: PrivateFrame, value: str, by: str) -> Released:
    """Two-sided, normal approximation with tie and continuity correction."""
    _two_groups(frame, value, by)
    df = frame._df.select(F.col(f"`{value}`").cast("double").alias("v"), F.col(f"`{by}`").alias("g")).where("v is not null and g is not null")
    cells = df.groupBy("v", "g").agg(F.count(F.lit(1)).alias("n"))
    joined = cells.join(ranks(df, "v", "r"), "v")
    rows = joined.groupBy("g").agg(F.sum("n"), F.sum(F.col("n") * F.col("r"))).orderBy("g").collect()
    ties = ranks(df, "v", "r").agg(F.sum(F.pow(F.col("__c").cast("double"), 3) - F.col("__c"))).first()[0]
    n1, n2 = rows[0][1], rows[1][1]
    u = rows[0][2] - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    if sd == 0:
        raise DisclosureError("there is no variation")
    z = (abs(u - n1 * n2 / 2) - 0.5) / sd
    return _out("mannwhitney", u, min(1.0, dist.normal_sf2(max(z, 0.0))), _shown(frame, n))


def chisq(frame: PrivateFrame, row: str, col: str) -> Released:
    """Pearson's test; with one degree of freedom Yates' correction. The table stays inside."""
    frame._need(row, col)
    cells = frame._df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n")).where(F.col(f"`{row}`").isNotNull() & F.col(f"`{col}`").isNotNull()).limit(100_001).collect()
    if len(cells) > 100_000:
        raise DisclosureError("the table has too many cells")
    rows, cols, n = {}, {}, 0
    for a, b, k in cells:
        rows[a], cols[b], n = rows.get(a, 0) + k, cols.get(b, 0) + k, n + k
    if len(rows) < 2 or len(cols) < 2 or min([*rows.values(), *cols.values()]) < frame._policy.min_n:
        raise DisclosureError("a margin has too few rows")
    df = (len(rows) - 1) * (len(cols) - 1)
    seen = {(a, b): k for a, b, k in cells}
    total = 0.0
    for a, x in rows.items():
        for b, y in cols.items():
            e = x * y / n
            d = abs(seen.get((a, b), 0) - e)
            d = d - min(0.5, d) if df == 1 else d
            total += d * d / e
    return _out("chisq", total, dist.chi2_sf(total, df), _shown(frame, n), df=df)


def corr_test(frame: PrivateFrame, x: str, y: str, method: str = "pearson") -> Released:
    a, b = (frame._col(c)._numeric()._expr.cast("double") for c in (x, y))
    df = frame._df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    if method == "spearman":
        df = df.join(ranks(df, "a", "ra").drop("__c"), "a").join(ranks(df, "b", "rb").drop("__c"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    elif method != "pearson":
        raise DisclosureError("method is pearson or spearman")
    n, r = df.agg(F.count(F.lit(1)), F.corr("a", "b")).first()
    if n < max(3, frame._policy.suppression.descriptive_n) or r is None:
        raise DisclosureError("too few rows, or no variation")
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    return _out("corr_test", r, dist.t_sf2(t, n - 2), _shown(frame, n), method=method)
