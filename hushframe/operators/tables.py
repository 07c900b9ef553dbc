"""Releasing verbs over columns, frames and groups. Each is one small aggregate with its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DisclosureError
from ..plans.quantiles import grouped_quantiles, quantiles
from . import release as R
from .frame import PrivateColumn, PrivateFrame, is_numeric

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df


def _rows(frame: PrivateFrame, value: Column | None, of: tuple[Column, ...] = ()) -> Column:
    """The rows that stand behind a cell: those with a value; of a grouped frame not more than the
    smallest group behind it; where a join or reshape repeats rows, not more than there are of those
    that the value (or ``of``, what the cell says) comes from."""
    n = F.count(F.lit(1)) if value is None else F.least(F.count(F.lit(1)), F.count(value))
    n = F.least(n, F.min(frame._support)) if frame._support else n
    known = F.lit(True) if value is None else value.isNotNull()
    sources = sorted({o for e in (*of, *([] if value is None else [value])) for o in frame._sources(e)})
    return R.not_more_than(frame._policy, n, [F.when(known, F.col(o)) for o in sources])


def _rows_where(frame: PrivateFrame, condition: Column, value: Column) -> Column:
    """The rows in which a condition on a value holds, repeated ones once."""
    return R.not_more_than(frame._policy, F.count_if(condition), [F.when(condition, F.col(o)) for o in frame._sources(value)])


def _hidden(frame: PrivateFrame) -> list[str]:
    """The columns that ``_rows`` reads besides the values."""
    return [*([frame._support] if frame._support else []), *sorted({o for own in frame._origin.values() for o in own})]


def _audit(frame: PrivateFrame, verb: str, k: int, **more) -> dict:
    s = frame._policy.suppression
    return {"verb": verb, "min_n": k, "count_noise": bool(s.count_noise), **more}


def group_agg(frame: PrivateFrame, by: list[str], value: str | None, stat: str, min_n=None, round=None, name: str = "value") -> R.Released:
    out = _grouped(frame, by, value, [stat], min_n, round, {stat: name})
    k = R.least_n(frame._policy, min_n, stat)
    return R.Released("series", _audit(frame, "group_agg", k, stat=stat, by=by), out, by, value or "size")


def group_agg_multi(frame: PrivateFrame, by: list[str], value: str, stats: list[str], min_n=None, round=None) -> R.Released:
    k = max(R.least_n(frame._policy, min_n, s) for s in stats)
    out = _grouped(frame, by, value, stats, k, round, {s: s for s in stats}, k)
    return R.Released("table", _audit(frame, "group_agg", k, stats=stats, by=by), out, by)


def _grouped(frame, by, value, stats, min_n, round, names, k=None) -> DataFrame:
    policy = frame._policy
    v = None if value is None else F.col(f"`{value}`")
    df = _known(frame._df, by)
    if v is not None and any(s not in ("count", "size") for s in stats) and not (is_numeric(frame._kind(value)) or isinstance(frame._kind(value), T.BooleanType)):
        raise DisclosureError("this statistic needs a numeric column")
    numeric = v is not None and is_numeric(frame._kind(value))
    limits = R.bounds(frame._df, v, policy) if numeric and any(s in R.MOMENTS for s in stats) else None
    aggs = [_rows(frame, None if stats == ["size"] else v).alias("__n")]
    for s in stats:
        if s != "median":
            aggs.append(R.aggregate(s, R.clip(v, limits) if s in R.MOMENTS and v is not None else v).alias(f"__{s}"))
    cells = df.groupBy(*by).agg(*aggs)
    if "median" in stats:
        cells = cells.join(grouped_quantiles(df, by, v, [0.5], "__q"), by, "left").withColumn("__median", F.col("__q")[0])
    base = R.rounding(policy, round)
    labels = [F.col(f"`{k}`") for k in by]
    out = []
    for s in stats:
        own = R.least_n(policy, min_n, s) if k is None else k
        c = F.col(f"__{s}")
        if s in ("count", "size") and policy.suppression.count_noise:
            c = R.noisy(policy, s, c, c, *labels)
        else:
            c = R.noisy(policy, s, R.round_to(c, base), F.col("__n"), *labels)
            if s == "median":
                c = R.sig_column(c, policy.suppression.percentile_sig_figs)
        out.append(R.suppress(c, F.col("__n"), own).alias(names[s]))
    return cells.select(*by, *out).orderBy(*by)


def group_describe(frame: PrivateFrame, by: list[str], value: str) -> R.Released:
    """Winsorised per group; an order statistic needs enough rows on either side of it."""
    policy, s = frame._policy, frame._policy.suppression
    v = F.col(f"`{value}`").cast("double")
    df = _known(frame._df, by).where(v.isNotNull())
    p = [*(s.winsorize or (0.0, 1.0)), 0.25, 0.5, 0.75]
    first = df.groupBy(*by).agg(_rows(frame, v).alias("__n")).join(grouped_quantiles(df, by, v, p, "p"), by)
    kd = s.descriptive_n
    joined = df.join(first, by)
    w = F.least(F.greatest(v, F.col("p")[0]), F.col("p")[1])
    orders = [("min", F.col("p")[0]), ("25%", F.col("p")[2]), ("50%", F.col("p")[3]), ("75%", F.col("p")[4]), ("max", F.col("p")[1])]
    sources = frame._sources(F.col(f"`{value}`"))
    aggs = [F.first("__n").alias("__n"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("std")]
    for name, c in orders:
        aggs += [F.first(c).alias(f"o_{name}"), F.least(*(R.not_more_than(policy, F.count_if(test), [F.when(test, F.col(o)) for o in sources]) for test in (v <= c, v >= c))).alias(f"s_{name}")]
    cells = joined.groupBy(*by).agg(*aggs)
    e = R.noise(policy, *[F.col(f"`{k}`") for k in by])
    count = F.col("__n") if e is None else F.greatest(F.col("__n") + e, F.lit(0))
    base = None if e is not None else policy.round_to
    ok = F.col("__n") >= policy.min_n
    out = [F.when(ok, R.round_to(count.cast("double"), base)).alias("count")]
    for name in ("mean", "std"):
        out.append(F.when(ok & (F.col("__n") >= kd), F.col(name)).alias(name))
    for name, _ in orders:
        out.append(F.when(ok & (F.col(f"s_{name}") >= kd), R.sig_column(F.col(f"o_{name}"), s.percentile_sig_figs)).alias(name))
    return R.Released("table", _audit(frame, "describe", policy.min_n, by=by), cells.select(*by, *out).orderBy(*by), by)


def _cell_rows(frame: PrivateFrame, *said: Column) -> Column:
    """The rows behind a cell of a table that says values of columns; the table has the hidden columns."""
    n = F.least(F.count(F.lit(1)), F.min(frame._support)) if frame._support else F.count(F.lit(1))
    return R.not_more_than(frame._policy, n, [F.col(o) for o in sorted({o for e in said for o in frame._sources(e)})])


def value_counts(frame: PrivateFrame, value: Column, name: str, min_n=None, round=None) -> R.Released:
    policy = frame._policy
    k = R.least_n(policy, min_n, "count")
    cells = frame._df.select(value.alias("key"), *_hidden(frame)).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("c"), _cell_rows(frame, value).alias("n"))
    R.stop_if_sparse(policy, cells)
    count = F.col("c").cast("double")
    count = R.noisy(policy, "count", count, F.col("c"), F.col("key")) if policy.suppression.count_noise else R.round_to(count, R.rounding(policy, round))
    out = cells.orderBy(F.desc("c"), "key").select(F.col("key").alias(name), R.suppress(count, F.col("n"), k).alias("count"))
    return R.Released("series", _audit(frame, "value_counts", k), out, [name], name)


def crosstab(frame: PrivateFrame, row: str, col: str, min_n=None, round=None) -> R.Released:
    """The whole grid; a cell without rows is under the minimum like any small one."""
    out = crosstab_long(frame, row, col, min_n, round)
    levels = [r[0] for r in frame._df.select(col).where(F.col(f"`{col}`").isNotNull()).distinct().orderBy(col).limit(1001).collect()]
    if len(levels) > 1000:
        raise DisclosureError("crosstab: more than 1000 columns")
    wide = out.groupBy(row).pivot(col, levels).agg(F.first("count")).orderBy(row)
    return R.Released("table", _audit(frame, "crosstab", R.least_n(frame._policy, min_n, "count")), wide, [row])


def crosstab_long(frame: PrivateFrame, row: str, col: str, min_n=None, round=None) -> DataFrame:
    policy = frame._policy
    k = R.least_n(policy, min_n, "count")
    cells = _known(frame._df, [row, col]).groupBy(row, col).agg(F.count(F.lit(1)).alias("__c"), _rows(frame, None, (F.col(f"`{row}`"), F.col(f"`{col}`"))).alias("__n"))
    R.stop_if_sparse(policy, cells, "__n")
    count = F.col("__c").cast("double")
    count = R.noisy(policy, "count", count, F.col("__c"), F.col(row), F.col(col)) if policy.suppression.count_noise else R.round_to(count, R.rounding(policy, round))
    return cells.select(row, col, R.suppress(count, F.col("__n"), k).alias("count"))


def pivot_table(frame: PrivateFrame, values: str, index, columns=None, aggfunc: str = "mean", min_n=None, round=None) -> R.Released:
    keys = frame._names(index)
    long = pivot_long(frame, values, keys, columns, aggfunc, min_n, round)
    audit = _audit(frame, "pivot_table", R.least_n(frame._policy, min_n, aggfunc), stat=aggfunc)
    if columns is None:
        return R.Released("series", audit, long.orderBy(*keys), keys, values)
    levels = [r[0] for r in frame._df.select(columns).where(F.col(f"`{columns}`").isNotNull()).distinct().orderBy(columns).limit(1001).collect()]
    if len(levels) > 1000:
        raise DisclosureError("pivot_table: more than 1000 columns")
    return R.Released("table", audit, long.groupBy(*keys).pivot(columns, levels).agg(F.first("value")).orderBy(*keys), keys)


def pivot_long(frame: PrivateFrame, values: str, keys: list[str], columns: str | None, aggfunc: str, min_n=None, round=None) -> DataFrame:
    """Cells by their non-missing rows, after the sparse stop."""
    R.check_stat(aggfunc)
    by = [*keys, *([columns] if columns else [])]
    frame._need(values, *by)
    known = _known(frame._df, by).groupBy(*by).agg(F.count(F.col(f"`{values}`")).alias("n"))
    R.stop_if_sparse(frame._policy, known)
    return _grouped(frame, by, values, [aggfunc], min_n, round, {aggfunc: "value"})


# ---------------------------------------------------------------- columns

def _stat(stat: str, v: Column, raw: Column) -> Column:
    n = F.count(v)
    d = v.cast("double")
    if stat == "sem":
        return F.stddev_samp(d) / F.sqrt(n)
    if stat == "skew":
        return R.skewness(n, F.skewness(d))
    if stat == "kurt":
        return R.kurtosis(n, F.kurtosis(d))
    if stat == "nunique":
        return F.count_distinct(raw).cast("double")
    return R.aggregate(stat, v)


def reduce_column(column: PrivateColumn, stat: str, min_n=None, round=None) -> R.Released:
    me = column._plain() if stat in ("count", "nunique") else column._numeric()
    frame = me._frame
    found = _reduced(frame, {me._name: me._expr}, stat, min_n, round)
    value, n = found[me._name]
    return R.scalar(value, _audit(frame, stat, R.least_n(frame._policy, min_n, _floor(stat)), n_ok=n))


def _floor(stat: str) -> str:
    return "count" if stat in ("count", "sum", "nunique") else "mean"


def _reduced(frame: PrivateFrame, exprs: dict[str, Column], stat: str, min_n, round) -> dict:
    """All columns in one job (and one before it for the winsorisation limits)."""
    policy, s = frame._policy, frame._policy.suppression
    limits = {}
    if s.winsorize and stat in (*R.MOMENTS, "sem", "skew", "kurt"):
        limits = quantiles(frame._df, exprs, list(s.winsorize))
    aggs = []
    for i, (c, e) in enumerate(exprs.items()):
        v = R.clip(e, limits[c]) if limits.get(c) else e
        aggs += [_stat(stat, v, e).alias(f"v{i}"), _rows(frame, e).alias(f"n{i}")]
    if stat == "median":
        middle = quantiles(frame._df, exprs, [0.5])
        aggs = [a for i, (c, e) in enumerate(exprs.items()) for a in (F.lit((middle[c] or [None])[0]).cast("double").alias(f"v{i}"), _rows(frame, e).alias(f"n{i}"))]
    row = frame._df.agg(*aggs).first()
    k = R.least_n(policy, min_n, _floor(stat))
    base = R.rounding(policy, round) if stat in R.STATS else None
    out = {}
    for i, c in enumerate(exprs):
        value, n = row[f"v{i}"], row[f"n{i}"]
        ok = n >= k
        if ok and value is not None:
            step = s.count_noise and stat in ("count", "sum", "mean", "nunique")
            if step:
                e = _driver_noise(policy, stat if stat != "nunique" else "count", c)
                moved = max(0, (value if stat == "nunique" else n) + e)
                value = float(moved) if stat in ("count", "nunique") else value * moved / n if stat == "sum" else value if moved else None
            if value is not None and base and not (step and stat == "count"):
                value = _even(value, base)
            if stat == "median":
                value = R.sig_figs(value, s.percentile_sig_figs)
        out[c] = (value if ok else None, ok)
    return out


def _even(value: float, base: int) -> float:
    return float(round(value / base) * base)


def _driver_noise(policy, *labels: str) -> int:
    import hashlib

    step = int(policy.suppression.count_noise)
    parts = [p for x in labels for p in (str(len(x)), x)]
    digest = hashlib.sha256("|".join([R.salt(policy), *parts]).encode()).hexdigest()
    return int(digest[:15], 16) % (2 * step + 1) - step


def reduce_frame(frame: PrivateFrame, stat: str, min_n=None, round=None) -> R.Released:
    if stat in ("count", "nunique"):
        exprs = {c: F.col(f"`{c}`") for c in frame._cols}
    else:
        exprs = {c: F.col(f"`{c}`") for c in frame._cols if is_numeric(frame._kind(c))}
    if not exprs:
        raise DisclosureError("this statistic needs a numeric column")
    found = _reduced(frame, exprs, stat, min_n, round)
    k = R.least_n(frame._policy, min_n, _floor(stat))
    made = {"type": "series", "name": stat, "index": list(exprs), "values": [R.clean(found[c][0]) for c in exprs]}
    return R.Released("series", _audit(frame, stat, k), made=made)


def _orders(frame: PrivateFrame, exprs: dict[str, Column], points: dict[str, float]) -> dict[str, dict[str, float | None]]:
    """Order statistics of columns: released if enough rows lie on either side, ends included."""
    s = frame._policy.suppression
    found = quantiles(frame._df, exprs, list(points.values()))
    aggs, at = [], []
    for c, e in exprs.items():
        for name, value in zip(points, found[c] or []):
            d = e.cast("double")
            aggs.append(F.least(_rows_where(frame, d <= F.lit(value), e), _rows_where(frame, d >= F.lit(value), e)))
            at.append((c, name, value))
    out: dict[str, dict[str, float | None]] = {c: dict.fromkeys(points) for c in exprs}
    if aggs:
        for (c, name, value), support in zip(at, frame._df.agg(*aggs).first()):
            if support >= s.descriptive_n:
                out[c][name] = R.sig_figs(value, s.percentile_sig_figs)
    return out


def _tail(policy, winsorize) -> float:
    if winsorize is not None:
        if not 0 <= float(winsorize) < 0.5:
            raise DisclosureError("winsorize lies between 0 and 0.5")
        return float(winsorize)
    limits = policy.suppression.winsorize
    return limits[0] if limits else 0.0


def order_column(column: PrivateColumn, stat: str, q: float, winsorize=None) -> R.Released:
    me = column._numeric()
    if not 0 <= float(q) <= 1:
        raise DisclosureError("a quantile lies between 0 and 1")
    p = _tail(me.policy, winsorize) if stat in ("min", "max") else 0.0
    at = p if stat == "min" else 1 - p if stat == "max" else float(q)
    value = _orders(me._frame, {me._name: me._expr}, {"v": at})[me._name]["v"]
    return R.scalar(value, _audit(me._frame, stat, me.policy.suppression.descriptive_n))


def _described(frame: PrivateFrame, exprs: dict[str, Column], winsorize) -> dict[str, list]:
    p = _tail(frame._policy, winsorize)
    points = {"min": p, "25%": 0.25, "50%": 0.5, "75%": 0.75, "max": 1 - p}
    orders = _orders(frame, exprs, points)
    parts = [_reduced(frame, exprs, stat, None, None) for stat in ("count", "mean", "std")]
    return {c: [parts[0][c][0], parts[1][c][0], parts[2][c][0], *orders[c].values()] for c in exprs}


DESCRIBED = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe_column(column: PrivateColumn, winsorize=None) -> R.Released:
    me = column._numeric()
    found = _described(me._frame, {me._name: me._expr}, winsorize)[me._name]
    made = {"type": "series", "name": me._name, "index": DESCRIBED, "values": [R.clean(v) for v in found]}
    return R.Released("series", _audit(me._frame, "describe", me.policy.min_n), made=made)


def describe_frame(frame: PrivateFrame, winsorize=None) -> R.Released:
    exprs = {c: F.col(f"`{c}`") for c in frame._cols if is_numeric(frame._kind(c))}
    if not exprs:
        raise DisclosureError("describe needs a numeric column")
    found = _described(frame, exprs, winsorize)
    data = [[found[c][i] for c in exprs] for i in range(len(DESCRIBED))]
    return R.rows(list(exprs), DESCRIBED, data, _audit(frame, "describe", frame._policy.min_n))


def boxplot(column: PrivateColumn) -> R.Released:
    me = column._numeric()
    p = _tail(me.policy, None)
    points = {"min": p, "25%": 0.25, "50%": 0.5, "75%": 0.75, "max": 1 - p}
    found = _orders(me._frame, {me._name: me._expr}, points)[me._name]
    return R.Released("plot", _audit(me._frame, "boxplot", me.policy.suppression.descriptive_n), made={"type": "chart", "kind": "box", "x": list(points), "y": [R.clean(v) for v in found.values()], "name": me._name})


def histogram(column: PrivateColumn, bins=10, percent: bool = False) -> R.Released:
    me = column._numeric()
    out, edges = histogram_long(me, bins, percent)
    cells = {r["bin"]: r["value"] for r in out.collect()}
    labels = [f"({a:g}, {b:g}]" for a, b in zip(edges[:-1], edges[1:])]
    return R.Released("plot", _audit(me._frame, "hist", me.policy.min_n), made={"type": "chart", "kind": "hist", "name": me._name, "x": labels, "y": [R.clean(cells.get(i)) for i in range(len(labels))], "edges": edges})


def histogram_long(me: PrivateColumn, bins=10, percent: bool = False) -> tuple[DataFrame, list[float]]:
    """bin, value: right-closed bins of the winsorised column, the lowest edge included."""
    frame, policy = me._frame, me.policy
    limits = R.bounds(frame._df, me._expr, policy)
    v = R.clip(me._expr, limits)
    if isinstance(bins, (list, tuple)):
        edges = sorted(float(b) for b in bins)
        if len(edges) < 2:
            raise DisclosureError("hist needs two edges at least")
    else:
        if not 1 <= int(bins) <= 1000:
            raise DisclosureError("hist takes 1 to 1000 bins")
        low, high = frame._df.agg(F.min(v), F.max(v)).first()
        if low is None:
            raise DisclosureError("there is nothing to count")
        edges = R.nice_edges(low, high, int(bins))
    spot = F.when(v == edges[0], 0)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        spot = spot.when((v > a) & (v <= b), i)
    cells = frame._df.select(spot.alias("bin"), *_hidden(frame)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("c"), _cell_rows(frame, me._expr).alias("n"))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))  # one row a bin
    count = F.col("c").cast("double")
    if policy.suppression.count_noise:
        count = R.noisy(policy, "count", count, F.col("c"), F.lit(me._name), F.col("bin"))
    value = F.bround(count * 100 / total, 2) if percent else R.round_to(count, None if policy.suppression.count_noise else policy.round_to)
    return cells.select("bin", R.suppress(value, F.col("n"), policy.min_n).alias("value")), edges


def matrix(frame: PrivateFrame, kind: str) -> R.Released:
    """Pairwise-complete correlation or covariance; each pair needs enough rows of its own."""
    own = [c for c in frame._cols if is_numeric(frame._kind(c))]
    if len(own) < 2:
        raise DisclosureError("two numeric columns are needed")
    k = frame._policy.suppression.descriptive_n
    aggs, pairs = [], []
    for i, a in enumerate(own):
        for b in own[i:]:
            x = F.when(F.col(f"`{b}`").isNotNull(), F.col(f"`{a}`").cast("double"))
            y = F.when(F.col(f"`{a}`").isNotNull(), F.col(f"`{b}`").cast("double"))
            aggs += [(F.corr(x, y) if kind == "corr" else F.covar_samp(x, y)), F.count(F.when(x.isNotNull() & y.isNotNull(), 1))]
            pairs.append((a, b))
    row = frame._df.agg(*aggs).first()
    cell = {}
    for j, (a, b) in enumerate(pairs):
        v = row[2 * j] if row[2 * j + 1] >= k else None
        cell[a, b] = cell[b, a] = None if v is None else round(v, 3)
    return R.rows(own, own, [[cell[a, b] for b in own] for a in own], _audit(frame, kind, k))
