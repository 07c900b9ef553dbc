"""Exact quantiles of whole columns in bounded memory.

Spark's exact percentile keeps every distinct value in one place. With few distinct values that is
the shortest way; with many, the range that holds a wanted rank is narrowed by counting rows in a
fixed number of bins, pass after pass, until few enough values are left to pick from; a pass serves
all ranks of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import edges, running_sums
from .store import keep

#: Distinct values that one percentile may keep, bins of a narrowing pass, and rows in a range that
#: are counted value by value.
DISTINCT, BINS, FEW = 200_000, 2048, 4096


def quantiles(df: DataFrame, columns: dict[str, Column], points: list[float]) -> dict[str, list[float] | None]:
    """For each column its quantiles with linear interpolation, missing values left out; None where
    there is no value."""
    if not columns or not points:
        return {c: [] for c in columns}
    exprs = [e.cast("double") for e in columns.values()]
    first = df.agg(*[f(e) for e in exprs for f in (F.count, F.min, F.max)], *[F.approx_count_distinct(e, 0.05) for e in exprs]).first()
    k = len(exprs)
    out: dict[str, list[float] | None] = {}
    short = {c: e for i, (c, e) in enumerate(columns.items()) if first[3 * k + i] <= 0.9 * DISTINCT}
    if short:
        ps = F.array(*[F.lit(float(p)) for p in points])
        found = df.agg(*[F.percentile(e.cast("double"), ps) for e in short.values()]).first()
        out |= {c: (list(v) if v is not None else None) for c, v in zip(short, found)}
    wide = {c: (e, *first[3 * i : 3 * i + 3]) for i, (c, e) in enumerate(zip(columns, exprs)) if c not in out}
    found = _at_ranks(df, {c: w[0] for c, w in wide.items()}, {(c, r): [w[2], w[3], w[1], r] for c, w in wide.items() for r in _ranks(points, w[1])})
    for c, (_, n, _, _) in wide.items():
        between = lambda at: found[c, int(at)] + (found[c, min(int(at) + 1, n - 1)] - found[c, int(at)]) * (at - int(at))  # noqa: B023, E731
        out[c] = [between(p * (n - 1)) for p in points]
    return {c: out[c] for c in columns}


def _ranks(points: list[float], n: int) -> set[int]:
    return {r for p in points for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}


def _at_ranks(df: DataFrame, columns: dict[str, Column], open_: dict[tuple[str, int], list]) -> dict[tuple[str, int], float]:
    """The values of ranks (from 0) of columns. open_: for each the lowest and highest value that it
    can be, how many rows lie between, and the rank among them. A pass counts rows for all of them:
    in BINS bins of each range, or value by value where few rows are left."""
    found = {}
    while True:
        for at, (low, high, _, _) in list(open_.items()):
            if low >= high:
                found[at] = low
                del open_[at]
        if not open_:
            return found
        ranges = list(dict.fromkeys((at[0], *state[:3]) for at, state in open_.items()))
        marks = []
        for i, (c, low, high, inside) in enumerate(ranges):
            v = columns[c]
            key = v if inside <= FEW else F.least(F.floor((v - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1)).cast("double")
            marks.append(F.when(v.between(low, high), F.struct(F.lit(i).alias("i"), key.alias("key"), v.alias("v"))))
        counted = df.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.i", "m.key")
        bins: dict[int, list] = {}
        for r in counted.agg(F.count(F.lit(1)).alias("n"), F.min("m.v").alias("low"), F.max("m.v").alias("high")).collect():  # BINS or FEW rows a range
            bins.setdefault(r["i"], []).append((r["low"], r["high"], r["n"]))
        for at, state in open_.items():
            for low, high, n in sorted(bins[ranges.index((at[0], *state[:3]))]):
                if state[3] < n:
                    state[:3] = low, high, n
                    break
                state[3] -= n


def grouped_quantiles(df: DataFrame, by: list[str], value: Column, points: list[float], out: str) -> DataFrame:
    """by, ``out`` array: exact quantiles of each group (keys that are not missing) from its value
    counts, which are summed by range of the value, so that no group is in one task."""
    own = [f"__k{i}" for i in range(len(by))]
    values = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(by, own)], value.cast("double").alias("__v")).where("__v is not null")
    for o in own:
        values = values.where(F.col(o).isNotNull())
    counted = keep(values.groupBy(*own, "__v").agg(F.count(F.lit(1)).alias("__c")), "counted")
    total = counted.groupBy(*own).agg(F.sum("__c").alias("__n"))
    ranked = running_sums(counted, own, "__v", {"__u": "__c"}, edges(counted, "__v")).join(total, own)
    made, picks = [], []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("__n") - 1)
        picks += [F.min(F.when(F.col("__u") > low, F.col("__v"))).alias(f"__a{i}"), F.min(F.when(F.col("__u") > high, F.col("__v"))).alias(f"__b{i}"), F.first(at - low).alias(f"__s{i}")]
        made.append(F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__s{i}"))
    return ranked.groupBy(*own).agg(*picks).select(*[F.col(o).alias(k) for k, o in zip(by, own)], F.array(*made).alias(out))
