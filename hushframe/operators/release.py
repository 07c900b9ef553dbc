"""The only place where aggregates leave: every releasing verb ends in ``Released``.

A releasing verb builds a small DataFrame of aggregates with their row counts, and the rules here
(minimum cell size, rounding, noise, sparse stop, support of order statistics) are projections over
that aggregate, so one plan computes value, count and suppression together.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DisclosureError
from ..plans.quantiles import quantiles
from ..policy import Policy

STATS = ("mean", "sum", "count", "size", "median", "std", "var")
#: Statistics whose input is winsorised.
MOMENTS = ("mean", "sum", "std", "var")
SALT = "HUSHFRAME_NOISE_SALT"


def clean(value):
    """A payload value: no NaN, no infinity."""
    if isinstance(value, float):
        return float(value) if math.isfinite(value) else None
    if hasattr(value, "item"):
        return clean(value.item())
    return value


@dataclass
class Released:
    """A cleared result. ``frame`` is the small suppressed DataFrame where there is one; the payload
    is collected from it when it is first asked for."""

    kind: str = "table"
    audit: dict = field(default_factory=dict)
    frame: DataFrame | None = None
    index: list[str] = field(default_factory=list)
    name: str = "value"
    made: Any = None

    @property
    def payload(self):
        if self.made is None and self.frame is not None:
            self.made = self._collect()
        return self.made

    def _collect(self):
        rows = self.frame.collect()  # one row for each released cell
        columns = [c for c in self.frame.columns if c not in self.index]
        label = lambda r: str(r[self.index[0]]) if len(self.index) == 1 else str(tuple(r[c] for c in self.index))
        index = [label(r) if self.index else str(k) for k, r in enumerate(rows)]
        if self.kind == "series":
            return {"type": "series", "name": self.name, "index": index, "values": [clean(r[columns[0]]) for r in rows]}
        return {"type": "frame", "columns": columns, "index": index, "data": [[clean(r[c]) for c in columns] for r in rows]}

    @property
    def plot(self):
        from .charts import ReleasedPlot

        return ReleasedPlot(self)


def scalar(value, audit: dict) -> Released:
    return Released("scalar", audit, made={"type": "scalar", "value": clean(value)})


def rows(columns: list[str], index: list[str], data: list[list], audit: dict) -> Released:
    return Released("table", audit, made={"type": "frame", "columns": columns, "index": index, "data": [[clean(v) for v in r] for r in data]})


def rounding(policy: Policy, asked: int | None) -> int | None:
    """The coarser of what the policy and the caller want."""
    both = [x for x in (policy.round_to, asked) if x]
    return max(both) if both else None


def least_n(policy: Policy, asked: int | None, stat: str) -> int:
    """The caller can only tighten."""
    return max(policy.suppression.floor(stat), int(asked or 0))


def round_to(c: Column, base: int | None) -> Column:
    return c if not base else F.bround(c / F.lit(float(base)), 0) * F.lit(float(base))


def suppress(value: Column, n: Column, k: int) -> Column:
    return F.when(n >= k, value)


def sig_figs(value: float | None, figures: int | None) -> float | None:
    if value is None or not figures or value == 0 or not math.isfinite(value):
        return value
    return round(value, figures - 1 - math.floor(math.log10(abs(value))))


def sig_column(c: Column, figures: int | None) -> Column:
    if not figures:
        return c
    scale = F.pow(F.lit(10.0), F.lit(figures - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.rint(c * scale) / scale)


def salt(policy: Policy) -> str:
    found = policy.suppression.noise_key or os.environ.get(SALT)
    if not found:
        raise DisclosureError(f"count noise needs a secret, in the policy or in {SALT}")
    return found


def noise(policy: Policy, *labels: Column) -> Column | None:
    """A whole number from -step to step, fixed by the salt and the cell's labels. Labels carry
    their length, so that no two cells read alike."""
    step = policy.suppression.count_noise
    if not step:
        return None
    step = int(step)
    parts = []
    for label in labels:
        text = F.coalesce(label.cast("string"), F.lit("\u0000"))
        parts += [F.char_length(text).cast("string"), text]
    digest = F.sha2(F.concat_ws("|", F.lit(salt(policy)), *parts).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(2 * step + 1)) - step


def noisy(policy: Policy, stat: str, value: Column, n: Column, *labels: Column) -> Column:
    """A count moves by its noise; a sum is scaled with its count; a mean is kept unless no row is
    left; other statistics stay."""
    e = noise(policy, *labels)
    if e is None:
        return value
    moved = F.greatest(n + e, F.lit(0))
    if stat in ("count", "size"):
        return moved.cast("double")
    if stat == "sum":
        return value * moved / n
    if stat == "mean":
        return F.when(moved > 0, value)
    return value


#: Up to so many rows the sketch behind approx_count_distinct does not count too many.
SURE = 20


def not_more_than(policy: Policy, n: Column, ids: list[Column]) -> Column:
    """A number of rows, but not more than the distinct ids of the rows that they come from. Where the
    minimum is small a sketch tells it; a cell far above it keeps its number."""
    for c in ids:
        if policy.suppression.descriptive_n <= SURE:
            distinct = F.approx_count_distinct(c, 0.05)
            n = F.when(distinct > 100 * SURE, n).otherwise(F.least(n, distinct))
        else:
            n = F.least(n, F.count_distinct(c))
    return n


def stop_if_sparse(policy: Policy, cells: DataFrame, n: str = "n") -> None:
    """Refuse a table in which too many cells are under the minimum."""
    limit = policy.suppression.max_low_cell_share
    if limit is None:
        return
    share = cells.where(F.col(n) > 0).agg(F.avg((F.col(n) < policy.min_n).cast("double"))).first()[0]
    if share is not None and share > limit:
        raise DisclosureError("the table is too sparse to be released; use fewer or larger cells")


def bounds(df: DataFrame, value: Column, policy: Policy) -> tuple[float, float] | None:
    """The winsorisation limits of a numeric column, or None."""
    limits = policy.suppression.winsorize
    if not limits:
        return None
    found = quantiles(df, {"v": value}, list(limits))["v"]
    return tuple(found) if found else None


def clip(value: Column, limits: tuple[float, float] | None) -> Column:
    v = value.cast("double")
    return v if limits is None else F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(limits[0])), F.lit(limits[1])))


def aggregate(stat: str, value: Column | None) -> Column:
    """One of STATS over a (winsorised) value."""
    if stat == "size":
        return F.count(F.lit(1)).cast("double")
    if stat == "count":
        return F.count(value).cast("double")
    v = value.cast("double")
    return {
        "mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "median": F.percentile(v, F.lit(0.5)),
        "std": F.stddev_samp(v), "var": F.var_samp(v),
    }[stat]


def check_stat(stat) -> str:
    if not isinstance(stat, str):
        raise DisclosureError("statistics are given by name; functions are not accepted")
    if stat not in STATS:
        raise DisclosureError(f"unknown statistic: {stat}; choose from {', '.join(STATS)}")
    return stat


def skewness(n, m):
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * m)


def kurtosis(n, m):
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m + 6))


def nice_edges(low: float, high: float, bins: int) -> list[float]:
    """Round-number edges that enclose the range, so they do not show its ends."""
    if high <= low:
        high = low + 1
    raw = (high - low) / max(1, bins)
    size = 10 ** math.floor(math.log10(raw))
    step = next(m * size for m in (1, 2, 2.5, 5, 10) if m * size >= raw * (1 - 1e-12))
    first = math.floor(low / step)
    last = math.ceil(high / step)
    return [round(k * step, 10) for k in range(first, max(last, first + 1) + 1)]
