"""The ``np`` and ``pd`` that scripts see."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DisclosureError
from ..operators.frame import PrivateColumn, PrivateFrame, is_numeric
from ..plans.quantiles import quantiles
from . import exprs as E


class Np:
    inf, nan, pi, e = math.inf, math.nan, math.pi, math.e

    def __getattr__(self, name):
        if name in E.UNARY:
            return lambda x: self._one(name, x)
        if name in E.BINARY:
            return lambda a, b: self._two(name, a, b)
        raise DisclosureError(f"np.{name} is not available")

    def _one(self, name, x):
        if isinstance(x, PrivateColumn):
            return x._plain()._new(E.UNARY[name](x._plain()._expr))
        own = {"square": lambda v: v * v, "abs": abs, "sign": lambda v: (v > 0) - (v < 0), "rint": round, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan}
        return float((own.get(name) or getattr(math, name))(self._number(x)))

    @staticmethod
    def _number(x) -> float:
        if isinstance(x, (int, float)):
            return x
        raise DisclosureError("a column or a number is needed")

    def _two(self, name, a, b):
        col = a if isinstance(a, PrivateColumn) else b if isinstance(b, PrivateColumn) else None
        if col is None:
            own = {"minimum": min, "maximum": max, "power": pow, "mod": lambda x, y: x % y, "hypot": math.hypot, "arctan2": math.atan2}
            return float(own[name](self._number(a), self._number(b)))
        me = col._plain()
        return me._new(E.BINARY[name](me._other(a), me._other(b)))

    def round(self, x, decimals=0):
        return x.round(decimals) if isinstance(x, PrivateColumn) else float(round(self._number(x), decimals))

    def where(self, cond, a, b):
        if not isinstance(cond, PrivateColumn):
            raise DisclosureError("np.where takes a private condition")
        me = cond._plain()
        return me._new(E.choose(me._expr, me._other(a), me._other(b)))


class Pd:
    def to_datetime(self, column):
        me = self._column(column)
        out = me._expr.try_cast("timestamp_ntz")
        if me._frame._df.agg(F.count_if(me._expr.isNotNull() & out.isNull())).first()[0]:
            raise DisclosureError("some values are not dates")
        return me._new(out)

    def to_numeric(self, column, errors="raise"):
        me = self._column(column)
        out = me._expr.try_cast("double")
        if errors != "coerce" and me._frame._df.agg(F.count_if(me._expr.isNotNull() & out.isNull())).first()[0]:
            raise DisclosureError("some values are not numbers")
        return me._new(out)

    @staticmethod
    def _column(column) -> PrivateColumn:
        if not isinstance(column, PrivateColumn):
            raise DisclosureError("a private column is needed")
        return column._plain()

    def cut(self, x, bins, labels=None, right=True):
        me = self._column(x)
        v = me._expr.cast("double")
        if isinstance(bins, int):
            low, high = me._frame._df.agg(F.min(v), F.max(v)).first()
            if low is None or not 1 <= bins <= 1000:
                raise DisclosureError("cut: nothing to cut, or too many bins")
            step = (high - low) / bins or 1.0
            edges = [low + i * step for i in range(bins + 1)]
            edges[0 if right else -1] += (-1 if right else 1) * (high - low) * 0.001
        else:
            edges = [float(b) for b in bins]
        return me._new(_binned(v, edges, labels, right, False))

    def qcut(self, x, q, labels=None):
        me = self._column(x)
        v = me._expr.cast("double")
        points = [i / q for i in range(q + 1)] if isinstance(q, int) else [float(p) for p in q]
        edges = quantiles(me._frame._df, {"v": v}, points)["v"]
        if edges is None or any(b <= a for a, b in zip(edges, edges[1:])):
            raise DisclosureError("qcut: the bin edges are not distinct")
        names = labels if labels is not None else [f"q{i + 1}" for i in range(len(edges) - 1)]
        return me._new(_binned(v, list(edges), names, True, True))

    def crosstab(self, row, col, min_n=None, round=None):
        a, b = self._column(row), self._column(col)
        frame = a._frame
        x, y = a._name, b._name if b._name != a._name else b._name + "_y"
        made = PrivateFrame(frame._df.withColumns({x: a._expr, y: frame._align(b)}), frame._policy, [x, y], support=frame._support)
        return made.crosstab(x, y, min_n, round)

    def merge(self, left, right, *, on, how="inner"):
        return left.merge(right, on=on, how=how)

    def __getattr__(self, name):
        raise DisclosureError(f"pd.{name} is not available")


def _binned(v, edges, labels, right, lowest):
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = ((v > a) & (v <= b)) if right else ((v >= a) & (v < b))
        if lowest and i == 0:
            inside = inside | (v == a)
        if labels is False:
            name = F.lit(i)
        elif labels is not None:
            if len(labels) != len(edges) - 1:
                raise DisclosureError("one label for each bin is needed")
            name = F.lit(str(labels[i]))
        else:
            name = F.lit(f"({a:g}, {b:g}]" if right else f"[{a:g}, {b:g})")
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def schema_entry(name: str, frame: PrivateFrame) -> dict:
    """Names, types and suppressed counts of a bound frame; never a value."""
    policy = frame._policy
    row = frame._df.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"`{c}`").isNull()) for c in frame._cols]).first()

    def shown(n):
        if n == 0:
            return 0
        if n < policy.min_n:
            return None
        return round(n / policy.round_to) * policy.round_to if policy.round_to else n

    kinds = [("number" if is_numeric(frame._kind(c)) else "boolean" if isinstance(frame._kind(c), T.BooleanType) else frame._kind(c).simpleString()) for c in frame._cols]
    return {"name": name, "n_rows": shown(row[0]), "n_columns": len(frame._cols), "columns": [{"name": c, "dtype": k, "n_missing": shown(n)} for c, k, n in zip(frame._cols, kinds, row[1:])]}
