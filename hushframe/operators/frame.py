"""Private frames and columns: facades that build lazy plans and never show a row.

A frame carries a hidden row id and an order (columns, ending in the id). A column knows the frame
it was made on. Used on that frame, or on one that only filtered or sorted it, its expression is
spliced in; elsewhere it is joined on the row id. Order-dependent columns are hidden columns of
their own frame, computed before any later filter.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DisclosureError
from ..functions import exprs as E
from ..plans import ordered as O
from ..plans.quantiles import grouped_quantiles
from ..plans.store import keep
from ..policy import Policy
from . import release as R

RID = "__rid"
#: Begins the hidden columns with a source's numbers as they are in the file.
RAW = "__raw_"
_ids = itertools.count(1)
CASTS = {
    "int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float",
    "str": "string", "string": "string", "object": "string", "bool": "boolean", "boolean": "boolean",
    "datetime64[ns]": "timestamp_ntz", "datetime64": "timestamp_ntz", "category": "string",
}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, E.NUMERIC)


#: Plan nodes that give the same rows in the same places each time.
_SCANS = ("LogicalRelation", "LocalRelation", "LogicalRDD", "Project", "Filter", "SubqueryAlias", "View", "Range", "RelationV2", "DataSourceV2Relation")


def is_scan(df: DataFrame) -> bool:
    def steady(node) -> bool:
        children = node.children()
        return node.nodeName().split(" ")[0] in _SCANS and all(steady(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic() and steady(plan)


def quiet_bool(what: str):
    def refuse(self, *_):
        raise DisclosureError(f"a private {what} has no length, truth value or iteration")

    return refuse


def _cast_name(dtype) -> str:
    name = dtype if isinstance(dtype, str) else getattr(dtype, "__name__", str(dtype))
    if name not in CASTS:
        raise DisclosureError(f"unknown type: {name}")
    return CASTS[name]


class PrivateColumn:
    """An expression on a frame. ``rowwise`` is false for expressions with a window."""

    def __init__(self, frame: "PrivateFrame", expr: Column, name: str = "value", rowwise: bool = True, bare: Column | None = None):
        self._frame, self._expr, self._name, self._rowwise = frame, expr, name, rowwise
        #: The same as a filter: NULL where the column is false, so that it can reach the scan.
        self._bare = bare

    # -- plumbing
    def _type(self) -> T.DataType:
        return self._frame._df.select(self._expr).schema[0].dataType

    def _new(self, expr: Column, rowwise: bool | None = None) -> "PrivateColumn":
        return PrivateColumn(self._frame, expr, self._name, self._rowwise if rowwise is None else rowwise)

    def _other(self, other) -> Column:
        """Another operand, on this column's frame."""
        if isinstance(other, PrivateColumn):
            return self._frame._align(other)
        if isinstance(other, (list, tuple, dict, set, PrivateFrame)):
            raise DisclosureError("operands are columns or single values")
        return F.lit(other)

    def _binary(self, f, other, turned: bool = False) -> "PrivateColumn":
        o = self._other(other)
        both = self._rowwise and getattr(other, "_rowwise", True)
        return PrivateColumn(self._frame, f(o, self._expr) if turned else f(self._expr, o), self._name, both)

    def _plain(self) -> "PrivateColumn":
        """The same column without a window inside: a hidden column of its frame."""
        if self._rowwise:
            return self
        return PrivateColumn(self._frame, F.col(self._frame._hide(self._expr)), self._name)

    @property
    def policy(self) -> Policy:
        return self._frame._policy

    __len__ = __bool__ = __iter__ = quiet_bool("column")
    __hash__ = None

    # -- comparisons and logic
    def _compared(self, op: str, other) -> "PrivateColumn":
        out = self._binary(lambda a, b: E.compare(op, a, b), other)
        if op != "!=" and not isinstance(other, PrivateColumn):
            out._bare = self._frame._raw_too(self._name, self._expr, lambda c: E.COMPARE[op](c, F.lit(other)))
        return out

    def __gt__(self, o): return self._compared(">", o)
    def __lt__(self, o): return self._compared("<", o)
    def __ge__(self, o): return self._compared(">=", o)
    def __le__(self, o): return self._compared("<=", o)
    def __eq__(self, o): return self._compared("==", o)
    def __ne__(self, o): return self._compared("!=", o)

    def __and__(self, o):
        out = self._binary(lambda a, b: E.truth(a) & E.truth(b), o)
        if isinstance(o, PrivateColumn) and o._frame is self._frame and (self._bare is not None or o._bare is not None):
            out._bare = self._as_filter() & o._as_filter()
        return out

    def _as_filter(self) -> Column:
        return self._expr if self._bare is None else self._bare

    def __or__(self, o): return self._binary(lambda a, b: E.truth(a) | E.truth(b), o)
    def __invert__(self): return self._new(~E.truth(self._expr))
    def isna(self): return self._new(self._expr.isNull())
    def notna(self): return self._new(self._expr.isNotNull())

    def isin(self, values):
        own = list(values)
        out = self._new(F.coalesce(self._expr.isin(own), F.lit(False)))
        out._bare = self._frame._raw_too(self._name, self._expr, lambda c: c.isin(own))
        return out

    def between(self, low, high):
        a, b = self._other(low), self._other(high)
        out = self._new(F.coalesce((self._expr >= a) & (self._expr <= b), F.lit(False)))
        if not isinstance(low, PrivateColumn) and not isinstance(high, PrivateColumn):
            out._bare = self._frame._raw_too(self._name, self._expr, lambda c: c.between(a, b))
        return out

    isnull, notnull = isna, notna

    # -- arithmetic
    def __add__(self, o): return self._binary(lambda a, b: F.concat(a, b) if isinstance(self._type(), T.StringType) else a + b, o)
    def __radd__(self, o): return self._binary(lambda a, b: a + b, o, True)
    def __sub__(self, o): return self._binary(lambda a, b: a - b, o)
    def __rsub__(self, o): return self._binary(lambda a, b: a - b, o, True)
    def __mul__(self, o): return self._binary(lambda a, b: a * b, o)
    def __rmul__(self, o): return self._binary(lambda a, b: a * b, o, True)
    def __truediv__(self, o): return self._binary(E.divide, o)
    def __rtruediv__(self, o): return self._binary(E.divide, o, True)
    def __floordiv__(self, o): return self._binary(lambda a, b: F.floor(E.divide(a, b)), o)
    def __mod__(self, o): return self._binary(E.floor_mod, o)
    def __pow__(self, o): return self._binary(E.power, o)
    def __neg__(self): return self._new(-self._expr)

    def astype(self, dtype): return self._new(self._expr.try_cast(_cast_name(dtype)))
    def round(self, decimals: int = 0): return self._new(E.round_even(self._expr, int(decimals)))
    def abs(self): return self._new(F.abs(self._expr))

    def _edit(self, new: Column) -> "PrivateColumn":
        self._frame._check_edits([(self._expr, new)])
        return self._new(new)

    def clip(self, lower=None, upper=None):
        me = self._plain()
        c = me._expr
        if lower is not None:
            c = F.greatest(c, F.lit(lower))
        if upper is not None:
            c = F.least(c, F.lit(upper))
        return me._edit(F.when(me._expr.isNotNull(), c))

    def fillna(self, value):
        me = self._plain()
        return me._edit(F.coalesce(me._expr, me._other(value)))

    def where(self, cond, other=None):
        me = self._plain()
        return me._edit(F.when(E.truth(me._other(cond)), me._expr).otherwise(me._other(other)))

    def mask(self, cond, other=None):
        me = self._plain()
        return me._edit(F.when(E.truth(me._other(cond)), me._other(other)).otherwise(me._expr))

    def replace(self, to_replace, value=None):
        me = self._plain()
        return me._edit(replaced(me._expr, to_replace, value))

    def map(self, mapping):
        if not isinstance(mapping, dict):
            raise DisclosureError("map takes a dict; functions are not accepted")
        me = self._plain()
        return me._edit(_lookup(me._expr, mapping, F.lit(None)))

    # -- order-dependent columns
    def _ordered(self, make) -> "PrivateColumn":
        """A column of a narrow frame of its own (row id, place, value), written once; it is joined
        on the row id where it meets other columns. make(df, bucket, place, column, out)"""
        me = self._plain()
        frame = me._frame
        frame._sequence()
        (b, p), c, out = frame._seq, f"__h{next(_ids)}", f"__h{next(_ids)}"
        support = [frame._support] if frame._support else []
        narrow = frame._df.select(RID, b, p, *support, me._expr.alias(c))
        side = PrivateFrame(keep(make(narrow, b, p, c, out).select(RID, b, p, *support, out), "column"), frame._policy, [], frame._order, support=frame._support)
        side._seq = frame._seq
        return PrivateColumn(side, F.col(out), me._name)

    def shift(self, periods: int = 1):
        return self._ordered(lambda df, b, p, c, out: O.moved(df, p, c, out, int(periods)))

    def diff(self, periods: int = 1):
        k = int(periods)
        return self._ordered(lambda df, b, p, c, out: O.moved(df, p, c, "__before", k).withColumn(out, F.col(c) - F.col("__before")))

    def pct_change(self, periods: int = 1):
        k = int(periods)
        return self.ffill()._ordered(lambda df, b, p, c, out: O.moved(df, p, c, "__before", k).withColumn(out, E.divide(F.col(c), F.col("__before")) - 1))

    def _running(self, kind):
        return self._ordered(lambda df, b, p, c, out: O.running(df, b, p, c, out, kind).withColumn(out, F.when(F.col(c).isNotNull(), F.col(out))))

    def cumsum(self): return self._running("sum")

    def cumprod(self):
        me = self._plain()
        return me._new(me._expr.cast("double"))._running("product")

    def cummax(self): return self._running("max")
    def cummin(self): return self._running("min")
    def ffill(self): return self._ordered(O.nearest)
    def bfill(self): return self._ordered(lambda *a: O.nearest(*a, ahead=True))

    def interpolate(self, method: str = "linear"):
        """Between the neighbours by rows; before the first stays missing, after the last stays last."""
        if method != "linear":
            raise DisclosureError("interpolate: only the linear method is available")

        def make(df, b, p, c, out):
            v, place = F.col(c).cast("double"), F.col(p)
            df = df.withColumn("__s", F.when(v.isNotNull(), F.struct(place.alias("p"), v.alias("v"))))
            df = O.nearest(O.nearest(df, b, p, "__s", "__back"), b, p, "__s", "__next", ahead=True)
            back, ahead = F.col("__back"), F.col("__next")
            share = E.divide(place - back["p"], ahead["p"] - back["p"])
            return df.withColumn(out, F.coalesce(v, back["v"] + (ahead["v"] - back["v"]) * share, back["v"]))

        return self._ordered(make)

    # -- accessors
    @property
    def str(self): return _Text(self)
    @property
    def dt(self): return _Dates(self)
    @property
    def plot(self):
        from .charts import ColumnPlot

        return ColumnPlot(self)

    # -- released
    def _numeric(self) -> "PrivateColumn":
        me = self._plain()
        kind = me._type()
        if isinstance(kind, T.BooleanType):
            return PrivateColumn(me._frame, me._expr.cast("double"), me._name)
        if not is_numeric(kind):
            raise DisclosureError("this statistic needs a numeric column")
        return me

    def _reduce(self, stat: str, min_n=None, round=None):
        from . import tables

        return tables.reduce_column(self, stat, min_n, round)

    def mean(self, min_n=None, round=None): return self._reduce("mean", min_n, round)
    def sum(self, min_n=None, round=None): return self._reduce("sum", min_n, round)
    def count(self, min_n=None, round=None): return self._reduce("count", min_n, round)
    def median(self, min_n=None, round=None): return self._reduce("median", min_n, round)
    def std(self, min_n=None, round=None): return self._reduce("std", min_n, round)
    def var(self, min_n=None, round=None): return self._reduce("var", min_n, round)
    def sem(self, min_n=None): return self._reduce("sem", min_n)
    def skew(self, min_n=None): return self._reduce("skew", min_n)
    def kurt(self, min_n=None): return self._reduce("kurt", min_n)
    kurtosis = kurt
    def nunique(self, min_n=None): return self._reduce("nunique", min_n)

    def min(self, winsorize=None): return self._order("min", 0.0, winsorize)
    def max(self, winsorize=None): return self._order("max", 1.0, winsorize)
    def quantile(self, q=0.5): return self._order("quantile", q, None)

    def _order(self, stat, q, winsorize):
        from . import tables

        return tables.order_column(self, stat, q, winsorize)

    def describe(self, winsorize=None):
        from . import tables

        return tables.describe_column(self, winsorize)

    def boxplot(self):
        from . import tables

        return tables.boxplot(self)

    def hist(self, bins=10, percent=False):
        from . import tables

        return tables.histogram(self, bins, percent)

    def value_counts(self, min_n=None, round=None):
        from . import tables

        me = self._plain()
        return tables.value_counts(me._frame, me._expr, me._name, min_n, round)


def replaced(c: Column, to_replace, value=None) -> Column:
    if isinstance(to_replace, dict):
        return _lookup(c, to_replace, c)
    if callable(to_replace) or callable(value) or isinstance(to_replace, (PrivateColumn, PrivateFrame)):
        raise DisclosureError("replace takes values or a dict")
    old = to_replace if isinstance(to_replace, (list, tuple)) else [to_replace]
    new = value if isinstance(value, (list, tuple)) else [value] * len(old)
    if len(old) != len(new):
        raise DisclosureError("replace: lists of different lengths")
    return _lookup(c, dict(zip(old, new)), c)


def _lookup(c: Column, mapping: dict, fallback: Column) -> Column:
    if any(callable(v) for v in mapping.values()):
        raise DisclosureError("functions are not accepted")
    out = None
    for old, new in mapping.items():
        hit = c.isNull() if old is None else (c == F.lit(old))
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return fallback if out is None else out.otherwise(fallback)


class _Text:
    """String functions of a column."""

    def __init__(self, column: PrivateColumn):
        me = column._plain()
        if is_numeric(me._type()):
            raise DisclosureError(".str needs a text column")
        self._c, self._e = me, me._expr.cast("string")

    def _is(self, c): return self._c._new(F.coalesce(c, F.lit(False)))
    def slice(self, start=None, stop=None, step=None): return self._c._new(E.slice_text(self._e, start, stop, step))
    def substr(self, start, length): return self._c._new(F.substring(self._e, int(start) + 1, int(length)))
    def upper(self): return self._c._new(F.upper(self._e))
    def lower(self): return self._c._new(F.lower(self._e))
    def title(self): return self._c._new(E.title(self._e))
    def capitalize(self): return self._c._new(E.capitalize(self._e))
    def strip(self, to_strip=None): return self._c._new(E.strip(self._e, "both", to_strip))
    def lstrip(self, to_strip=None): return self._c._new(E.strip(self._e, "left", to_strip))
    def rstrip(self, to_strip=None): return self._c._new(E.strip(self._e, "right", to_strip))
    def len(self): return self._c._new(F.char_length(self._e))
    def pad(self, width, side="left", fillchar=" "): return self._c._new(E.pad(self._e, int(width), side, fillchar))
    def zfill(self, width): return self._c._new(E.zfill(self._e, int(width)))

    def _pattern(self, pat) -> str:
        if not isinstance(pat, str) or len(pat) > 200:
            raise DisclosureError("a pattern is a string of at most 200 characters")
        return pat

    def replace(self, pat, repl, regex=False):
        p = self._pattern(pat)
        return self._c._new(F.regexp_replace(self._e, p, repl) if regex else F.replace(self._e, F.lit(p), F.lit(repl)))

    def contains(self, pat, regex=False):
        p = self._pattern(pat)
        return self._is(self._e.rlike(p) if regex else self._e.contains(p))

    def cat(self, others=None, sep=""):
        if others is None:
            raise DisclosureError("cat needs another column")
        return self._c._new(F.concat(self._e, F.lit(sep), self._c._other(others).cast("string")))

    def startswith(self, pat): return self._is(self._e.startswith(pat))
    def endswith(self, pat): return self._is(self._e.endswith(pat))
    def find(self, sub): return self._c._new(F.instr(self._e, sub) - 1)

    def __getattr__(self, name):
        raise DisclosureError(f".str.{name} is not available")


class _Dates:
    """Date functions of a column; text is read as timestamps."""

    def __init__(self, column: PrivateColumn):
        me = column._plain()
        kind = me._type()
        self._c = me
        dated = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType))
        self._e = me._expr if dated else me._expr.try_cast("timestamp_ntz")

    def _get(self, f): return self._c._new(f(self._e))
    @property
    def days(self): return self._get(lambda c: F.floor(_seconds(c) / 86400))
    @property
    def year(self): return self._get(F.year)
    @property
    def month(self): return self._get(F.month)
    @property
    def day(self): return self._get(F.dayofmonth)
    @property
    def quarter(self): return self._get(F.quarter)
    @property
    def dayofweek(self): return self._get(F.weekday)
    weekday = dayofweek
    @property
    def dayofyear(self): return self._get(F.dayofyear)
    @property
    def days_in_month(self): return self._get(lambda c: F.dayofmonth(F.last_day(c)))
    @property
    def is_month_start(self): return self._get(lambda c: F.coalesce(F.dayofmonth(c) == 1, F.lit(False)))
    @property
    def is_month_end(self): return self._get(lambda c: F.coalesce(c.cast("date") == F.last_day(c), F.lit(False)))
    @property
    def hour(self): return self._get(F.hour)
    @property
    def minute(self): return self._get(F.minute)
    @property
    def second(self): return self._get(lambda c: F.second(c))

    def __getattr__(self, name):
        raise DisclosureError(f".dt.{name} is not available")


def _seconds(c: Column) -> Column:
    """Seconds of a day-time interval."""
    return F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")


class PrivateFrame:
    """A private table."""

    def __init__(self, df: DataFrame, policy: Policy, columns: list[str], order: list[tuple[str, bool]] | None = None, kin: frozenset = frozenset(), support: str | None = None, origin: dict[str, tuple[str, ...]] | None = None):
        self._df, self._policy, self._cols = df, policy, list(columns)
        self._order = order or []
        self._id = next(_ids)
        #: Frames whose row-wise expressions hold here.
        self._kin = kin | {self._id}
        #: Hidden column with the least number of rows behind each row (of grouped frames).
        self._support = support
        #: Where rows of a source may be repeated (joins, explode, melt): for each column the hidden
        #: columns with the ids of the rows that its value comes from.
        self._origin = origin or {}
        #: Hidden columns with each row's range and place in the order.
        self._seq: tuple[str, str] | None = None

    @classmethod
    def bind(cls, df: DataFrame, policy: Policy, key: list[str] | None = None) -> "PrivateFrame":
        """A source: NaN becomes NULL, decimals become doubles, rows get an id (of ``key`` if given,
        which must tell rows apart). A source that is more than a scan is written once, since its
        rows could get other ids each time."""
        out = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                out.append(c.alias(RAW + f.name))
                c = F.when(~F.isnan(c), c)
            elif isinstance(f.dataType, T.DecimalType):
                c = c.cast("double")
            elif isinstance(f.dataType, T.TimestampType):
                c = c.cast("timestamp_ntz")
            out.append(c.alias(f.name))
        if key:
            if df.groupBy(*key).count().where("count > 1").head(1):
                raise ValueError("the key columns do not tell all rows apart")
            return cls(df.select(*out, F.xxhash64(*key).alias(RID)), policy, df.columns)
        if not is_scan(df):
            df = keep(df.withColumn(RID, F.monotonically_increasing_id()), "source")
            return cls(df.select(*out, RID), policy, [c for c in df.columns if c != RID])
        return cls(df.select(*out).withColumn(RID, F.monotonically_increasing_id()), policy, df.columns)

    # -- plumbing
    def _kind(self, name: str) -> T.DataType:
        return self._df.schema[name].dataType

    def _raw_too(self, name: str, expr: Column, test) -> Column:
        """A filter on a column; of a source's numbers also on what is in the file: it follows from
        the first (NaN apart, which that drops) and reaches the scan."""
        raw = RAW + name
        if raw in self._df.columns and expr._jc.equals(F.col(f"`{name}`")._jc):
            return test(F.col(f"`{raw}`")) & test(expr)
        return test(expr)

    def _need(self, *names) -> list[str]:
        for n in names:
            if not isinstance(n, str) or n not in self._cols:
                raise DisclosureError(f"unknown column: {n}" if isinstance(n, str) else "columns are given by name")
        return list(names)

    def _names(self, by) -> list[str]:
        return self._need(*([by] if isinstance(by, str) else list(by) if isinstance(by, (list, tuple)) else [by]))

    def _col(self, name: str) -> PrivateColumn:
        self._need(name)
        return PrivateColumn(self, F.col(f"`{name}`"), name)

    def _like(self, df: DataFrame, columns=None, kin: bool = False, order=None, support="", origin=None) -> "PrivateFrame":
        cols = self._cols if columns is None else columns
        own = self._order if order is None else order
        return PrivateFrame(df, self._policy, cols, own, self._kin if kin else frozenset(), self._support if support == "" else support, self._origin if origin is None else origin)

    def _sources(self, expr: Column) -> list[str]:
        """The hidden columns with the ids of the rows that an expression's value comes from."""
        if not self._origin:
            return []
        read = self._df.select(expr.alias("x"))._jdf.queryExecution().analyzed().expressions().apply(0).references().toSeq()
        names = [read.apply(i).name() for i in range(read.size())]
        return sorted({o for n in names for o in self._origin.get(n, ())})

    def _repeated(self) -> tuple[list[Column], dict[str, tuple[str, ...]]]:
        """What a frame that may repeat these rows carries on: hidden columns (named anew) and, for
        each column, those with the rows that it comes from. Behind a row of groups stand the rows
        that its support counts."""
        fresh = f"__o{next(_ids)}"
        old = sorted({o for own in self._origin.values() for o in own})
        new = {o: f"__o{next(_ids)}" for o in old}
        carried = [F.col(RID).alias(fresh), *(F.col(o).alias(n) for o, n in new.items())]
        return carried, {c: tuple(new[o] for o in self._origin[c]) if c in self._origin else () if self._support else (fresh,) for c in self._cols}

    def _sequence(self) -> None:
        """Give the rows their places in this frame's order, once."""
        if self._seq is None:
            by = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in self._order]
            bucket, place = (f"__{x}{next(_ids)}" for x in "bp")
            self._df = O.number(self._df, [*by, F.col(RID).asc()], bucket, place)
            self._seq = (bucket, place)

    def _hide(self, expr: Column) -> str:
        """A hidden column of this frame with an expression that has a window."""
        name = f"__h{next(_ids)}"
        self._df = self._df.withColumn(name, expr)
        return name

    def _align(self, column: PrivateColumn) -> Column:
        """Another frame's column as an expression on this one."""
        if column._frame is self:
            return column._plain()._expr
        if column._rowwise and column._frame._id in self._kin:
            return column._expr
        me = column._plain()
        name = f"__h{next(_ids)}"
        behind = [F.col(me._frame._support).alias(name + "_support")] if me._frame._support else []
        other = me._frame._df.select(F.col(RID).alias(name + "_id"), me._expr.alias(name), *behind)
        self._df = self._df.join(other, self._df[RID] == F.col(name + "_id"), "left").drop(name + "_id")
        if behind:
            least = F.least(self._support, name + "_support") if self._support else F.col(name + "_support")
            self._df = self._df.withColumn(name + "_least", least)
            self._support = name + "_least"
        return F.col(name)

    def _need_support(self) -> None:
        """Refuse rows that few rows of a source stand behind, where they count one by one."""
        if self._support:
            least = self._df.agg(F.min(self._support)).first()[0]
            if least is not None and least < self._policy.suppression.min_n:
                raise DisclosureError("too few rows stand behind a row of this frame")

    def _check_edits(self, edits: list[tuple[Column, Column]]) -> None:
        """An edit touches none, or enough rows, or leaves enough untouched."""
        m = self._policy.suppression.min_edit_units
        if not m:
            return
        changed = [F.count_if(~old.eqNullSafe(new)) for old, new in edits]
        n, *found = self._df.agg(F.count(F.lit(1)), *changed).first()
        for k in found:
            if 0 < k < m or n - m < k < n:
                raise DisclosureError("the edit touches, or leaves untouched, too few units")

    __len__ = __bool__ = __iter__ = quiet_bool("frame")

    # -- columns
    def __getitem__(self, what):
        if isinstance(what, str):
            return self._col(what)
        if isinstance(what, list):
            return self._like(self._df, self._names(what), kin=True)
        if isinstance(what, PrivateColumn):
            if not isinstance(what._type(), T.BooleanType):
                raise DisclosureError("a mask is a column of truth values")
            here = what._frame is self or what._frame._id in self._kin
            cond = what._as_filter() if here and what._rowwise else self._align(what)
            return self._like(self._df.where(cond), kin=True)
        raise DisclosureError("select by column name, list of names, or mask")

    def __getattr__(self, name):
        if not name.startswith("_") and name in self._cols:
            return self._col(name)
        raise DisclosureError(f"'{name}' is not available on a private frame")

    # -- transforms
    def assign(self, *args, **columns) -> "PrivateFrame":
        if args:
            if len(args) != 2 or not all(isinstance(a, str) for a in args) or columns:
                raise DisclosureError("assign takes name=column, or a name and an expression")
            own = {c: F.col(f"`{c}`") for c in self._cols}
            columns = {args[0]: PrivateColumn(self, E.compile_expr(args[1], own))}
        new = {}
        for name, value in columns.items():
            if name.startswith("_"):
                raise DisclosureError("column names do not begin with '_'")
            if isinstance(value, PrivateColumn):
                new[name] = self._align(value)
            elif value is None or isinstance(value, (int, float, str, bool)):
                new[name] = F.lit(value)
            else:
                raise DisclosureError("assign takes columns and single values")
        origin = self._origin | {n: tuple(self._sources(e)) for n, e in new.items()} if self._origin else None
        return self._like(self._changed(new), self._cols + [n for n in new if n not in self._cols], origin=origin)

    def _changed(self, new: dict[str, Column]) -> DataFrame:
        """The rows with new columns; what the file has of columns of these names no longer counts."""
        return self._df.withColumns(new).drop(*[RAW + n for n in new])

    def rename(self, columns: dict) -> "PrivateFrame":
        own = {k: v for k, v in columns.items() if k in self._cols}
        left = [own.get(c, c) for c in self._cols]
        if len(set(left)) < len(left) or any(str(c).startswith("_") for c in own.values()):
            raise DisclosureError("rename gives unusable names")
        order = [(own.get(c, c), up) for c, up in self._order]
        return self._like(self._df.withColumnsRenamed(own).drop(*[RAW + c for pair in own.items() for c in pair]), left, order=order, origin={own.get(c, c): o for c, o in self._origin.items()})

    def drop(self, columns) -> "PrivateFrame":
        gone = self._names(columns)
        return self._like(self._df, [c for c in self._cols if c not in gone], kin=True)

    def select_dtypes(self, include=None, exclude=None) -> "PrivateFrame":
        def fits(kind, names):
            for n in [names] if isinstance(names, str) else names or []:
                n = n if isinstance(n, str) else n.__name__
                if n in ("number",) and is_numeric(kind):
                    return True
                if n in ("object", "str", "string") and isinstance(kind, T.StringType) or n in ("bool", "boolean") and isinstance(kind, T.BooleanType):
                    return True
                if n.startswith("datetime") and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                    return True
                if n.startswith("int") and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or n.startswith("float") and isinstance(kind, (T.FloatType, T.DoubleType)):
                    return True
            return False

        keep = [c for c in self._cols if (include is None or fits(self._kind(c), include)) and not (exclude is not None and fits(self._kind(c), exclude))]
        return self._like(self._df, keep, kin=True)

    def filter(self, items=None, like=None, regex=None) -> "PrivateFrame":
        if sum(x is not None for x in (items, like, regex)) != 1:
            raise DisclosureError("filter takes one of items, like and regex")
        if items is not None:
            keep = [c for c in items if c in self._cols]
        elif like is not None:
            keep = [c for c in self._cols if like in c]
        else:
            keep = [c for c in self._cols if re.search(str(regex)[:200], c)]
        return self._like(self._df, keep, kin=True)

    def where(self, col: str, op: str, value) -> "PrivateFrame":
        if op not in E.COMPARE:
            raise DisclosureError("where: the operator is one of > < >= <= == !=")
        # top-level comparisons stay bare (NULL drops the row), so they reach the scan
        return self._like(self._df.where(self._raw_too(col, self._col(col)._expr, lambda c: E.COMPARE[op](c, F.lit(value)))), kin=True)

    def dropna(self, subset=None) -> "PrivateFrame":
        names = self._cols if subset is None else self._names(subset)
        return self._like(self._df.na.drop("any", subset=names), kin=True)

    def drop_duplicates(self, subset=None) -> "PrivateFrame":
        names = self._cols if subset is None else self._names(subset)
        by = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in self._order] + [F.col(RID)]
        w = Window.partitionBy(*names).orderBy(*by)
        return self._like(self._df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k"), kin=True)

    def sort_values(self, by, ascending=True) -> "PrivateFrame":
        names = self._names(by)
        up = ascending if isinstance(ascending, list) else [ascending] * len(names)
        return self._like(self._df, kin=True, order=[(n, bool(u)) for n, u in zip(names, up)])

    def fillna(self, value) -> "PrivateFrame":
        fills = value if isinstance(value, dict) else {c: value for c in self._cols if _fits(self._kind(c), value)}
        self._need(*fills)
        return self._edited({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})

    def replace(self, to_replace, value=None) -> "PrivateFrame":
        if isinstance(to_replace, dict) and to_replace and all(isinstance(v, dict) for v in to_replace.values()):
            self._need(*to_replace)
            return self._edited({c: _lookup(F.col(c), m, F.col(c)) for c, m in to_replace.items()})
        keys = list(to_replace) if isinstance(to_replace, (dict, list, tuple)) else [to_replace]
        own = [c for c in self._cols if all(_fits(self._kind(c), k) for k in keys)]
        return self._edited({c: replaced(F.col(c), to_replace, value) for c in own})

    def clip(self, lower=None, upper=None) -> "PrivateFrame":
        def one(c):
            out = F.col(c)
            out = out if lower is None else F.greatest(out, F.lit(lower))
            out = out if upper is None else F.least(out, F.lit(upper))
            return F.when(F.col(c).isNotNull(), out)

        return self._edited({c: one(c) for c in self._cols if is_numeric(self._kind(c))})

    def _edited(self, new: dict[str, Column]) -> "PrivateFrame":
        self._check_edits([(F.col(c), e) for c, e in new.items()])
        return self._like(self._changed(new))

    def astype(self, dtype) -> "PrivateFrame":
        kinds = dtype if isinstance(dtype, dict) else {c: dtype for c in self._cols}
        self._need(*kinds)
        return self._like(self._changed({c: F.col(c).try_cast(_cast_name(t)) for c, t in kinds.items()}))

    def round(self, decimals: int = 0) -> "PrivateFrame":
        own = [c for c in self._cols if isinstance(self._kind(c), (T.FloatType, T.DoubleType))]
        return self._like(self._changed({c: E.round_even(F.col(c), int(decimals)) for c in own}))

    # -- joins and grouped frames
    def merge(self, other: "PrivateFrame", *, on, how: str = "inner") -> "PrivateFrame":
        """Equal keys, NULL keys among them, as in pandas; clashing columns of the right get ``_y``."""
        if not isinstance(other, PrivateFrame) or how not in ("inner", "left", "right", "outer"):
            raise DisclosureError("merge takes a private frame, on= and how= inner, left, right or outer")
        keys = self._names(on)
        other._need(*keys)
        right = {c: c + "_y" if c in self._cols else c for c in other._cols if c not in keys}
        behind = lambda frame, name: [F.col(frame._support).alias(name)] if frame._support else []
        (l_ids, l_from), (r_ids, r_from) = self._repeated(), other._repeated()
        l = self._df.select(*[F.col(f"`{c}`").alias(f"l_{c}") for c in self._cols], F.col(RID).alias("l_rid"), *behind(self, "l__support"), *l_ids)
        r = other._df.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in other._cols], F.col(RID).alias("r_rid"), *behind(other, "r__support"), *r_ids)
        cond = None
        for k in keys:
            same = l[f"l_{k}"].eqNullSafe(r[f"r_{k}"])
            cond = same if cond is None else cond & same
        joined = l.join(r, cond, how)
        out = [(F.coalesce(f"l_{c}", f"r_{c}") if c in keys else F.col(f"l_{c}")).alias(c) for c in self._cols]
        out += [F.col(f"r_{c}").alias(n) for c, n in right.items()]
        supports = [c for c in ("l__support", "r__support") if c in joined.columns]
        if supports:  # the rows behind a joined row are the fewer of those behind its two sides
            out.append((F.least(*supports) if len(supports) > 1 else F.col(supports[0])).alias("__support"))
        origin = {c: l_from[c] + (r_from[c] if c in keys and how in ("right", "outer") else ()) for c in self._cols} | {n: r_from[c] for c, n in right.items()}
        df = joined.select(*out, *[c for c in joined.columns if c.startswith("__o")], F.xxhash64("l_rid", "r_rid").alias(RID))
        return PrivateFrame(df, self._policy, self._cols + list(right.values()), support="__support" if supports else None, origin=origin)

    def summarise(self, by, **out) -> "PrivateFrame":
        """A private frame of groups; it remembers the rows behind each."""
        keys = self._names(by)
        aggs = []
        for name, spec in out.items():
            if not isinstance(spec, tuple) or len(spec) != 2:
                raise DisclosureError("summarise takes name=(column, statistic)")
            self._need(spec[0])
            aggs.append(R.aggregate(R.check_stat(spec[1]), F.col(f"`{spec[0]}`")).alias(name))
        support = F.sum(self._support) if self._support else F.count(F.lit(1))
        sources = sorted({o for spec in out.values() for o in self._sources(F.col(f"`{spec[0]}`"))})
        support = R.not_more_than(self._policy, support, [F.col(o) for o in sources])
        known = self._df.where(" and ".join(f"`{k}` is not null" for k in keys))
        df = known.groupBy(*keys).agg(*aggs, support.alias("__support")).withColumn(RID, F.xxhash64(*keys))
        return PrivateFrame(df, self._policy, [*keys, *out], support="__support")

    summarize = summarise

    def groupby(self, by) -> "PrivateGroups":
        return PrivateGroups(self, self._names(by))

    # -- reshapes
    def melt(self, id_vars=None, value_vars=None, var_name="variable", value_name="value") -> "PrivateFrame":
        ids = [] if id_vars is None else self._names(id_vars)
        vals = [c for c in self._cols if c not in ids] if value_vars is None else self._names(value_vars)
        kinds = {self._kind(c) for c in vals}
        kind = "double" if all(is_numeric(k) for k in kinds) else "string"
        one = kinds.pop().simpleString() if len(kinds) == 1 else kind
        carried, origin = self._repeated()
        names = [RID, *([self._support] if self._support else [])]
        df = self._df.select(*ids, *names, *carried, *[F.col(c).cast(one).alias(c) for c in vals])
        df = df.unpivot([c for c in df.columns if c not in vals], vals, var_name, value_name)
        origin = {c: origin[c] for c in ids} | {value_name: tuple(sorted({o for c in vals for o in origin[c]}))}
        return PrivateFrame(df.withColumn(RID, F.xxhash64(RID, var_name)), self._policy, [*ids, var_name, value_name], support=self._support, origin=origin)

    def pivot(self, index, columns, values) -> "PrivateFrame":
        keys = self._names(index)
        self._need(columns, values)
        behind = F.min(self._support) if self._support else F.lit(None).cast("long")
        groups = self._df.groupBy(*keys, columns).agg(F.count(F.lit(1)).alias("n"), F.first(values).alias("v"), behind.alias("s"))
        if groups.where("n > 1").limit(1).count():
            raise DisclosureError("pivot: several rows have the same index and column")
        levels = [r[0] for r in self._df.select(columns).distinct().orderBy(columns).limit(1001).collect() if r[0] is not None]
        if len(levels) > 1000:
            raise DisclosureError("pivot: more than 1000 columns")
        df = groups.groupBy(*keys).pivot(columns, levels).agg(F.first("v"))
        if self._support:
            least = groups.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("s").alias("__support"))
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
            df = df.join(least, same).drop(*[f"__k{i}" for i in range(len(keys))])
        return PrivateFrame(df.withColumn(RID, F.xxhash64(*keys)), self._policy, [*keys, *map(str, levels)], support="__support" if self._support else None)

    def explode(self, column) -> "PrivateFrame":
        self._need(column)
        if not isinstance(self._kind(column), T.ArrayType):
            return self
        carried, origin = self._repeated()
        df = self._df.select("*", *carried, F.posexplode_outer(column).alias("__p", "__v")).withColumn(column, F.col("__v"))
        return PrivateFrame(df.withColumn(RID, F.xxhash64(RID, "__p")).drop("__p", "__v"), self._policy, self._cols, support=self._support, origin=origin)

    def stack(self) -> PrivateColumn:
        """Values of all numeric columns below each other, without missing ones."""
        own = [c for c in self._cols if is_numeric(self._kind(c))]
        if not own:
            raise DisclosureError("stack needs numeric columns")
        return self[own].melt().dropna(["value"])["value"]

    def unstack(self, level=-1) -> PrivateColumn:
        own = [c for c in self._cols if is_numeric(self._kind(c))]
        if not own:
            raise DisclosureError("unstack needs numeric columns")
        if level not in (-1, 0):
            raise DisclosureError("unstack: rows have one level, 0 or -1")
        return self[own].melt()["value"]

    # -- released
    def __dir__(self):
        return sorted({*type(self).__dict__, *self._cols})

    def value_counts(self, column, min_n=None, round=None):
        return self._col(column).value_counts(min_n, round)

    def crosstab(self, row, col, min_n=None, round=None):
        from . import tables

        self._need(row, col)
        return tables.crosstab(self, row, col, min_n, round)

    def pivot_table(self, values, index, columns=None, aggfunc="mean", min_n=None, round=None):
        from . import tables

        return tables.pivot_table(self, values, index, columns, aggfunc, min_n, round)

    def corr(self):
        from . import tables

        return tables.matrix(self, "corr")

    def cov(self):
        from . import tables

        return tables.matrix(self, "cov")

    def _wide(self, stat, min_n=None, round=None):
        from . import tables

        return tables.reduce_frame(self, stat, min_n, round)

    def mean(self, min_n=None, round=None): return self._wide("mean", min_n, round)
    def sum(self, min_n=None, round=None): return self._wide("sum", min_n, round)
    def median(self, min_n=None, round=None): return self._wide("median", min_n, round)
    def std(self, min_n=None, round=None): return self._wide("std", min_n, round)
    def var(self, min_n=None, round=None): return self._wide("var", min_n, round)
    def count(self, min_n=None, round=None): return self._wide("count", min_n, round)
    def nunique(self, min_n=None): return self._wide("nunique", min_n)

    def describe(self, winsorize=None):
        from . import tables

        return tables.describe_frame(self, winsorize)


def _fits(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_numeric(kind)
    return isinstance(kind, T.StringType)


class PrivateGroups:
    """A grouped frame: statistics by the name of a column."""

    def __init__(self, frame: PrivateFrame, by: list[str]):
        self._frame, self._by = frame, by

    def __getitem__(self, value):
        if not isinstance(value, str):
            raise DisclosureError("choose one column")
        self._frame._need(value)
        return PrivateSeriesGroups(self._frame, self._by, value)

    def __getattr__(self, name):
        if not name.startswith("_") and name in self._frame._cols:
            return self[name]
        raise DisclosureError(f"'{name}' is not available on groups")

    def size(self, min_n=None, round=None):
        from . import tables

        return tables.group_agg(self._frame, self._by, None, "size", min_n, round)

    def _agg(self, stat, value, min_n=None, round=None):
        return getattr(self[value], stat)(min_n=min_n, round=round)

    def mean(self, value, min_n=None, round=None): return self._agg("mean", value, min_n, round)
    def sum(self, value, min_n=None, round=None): return self._agg("sum", value, min_n, round)
    def count(self, value, min_n=None, round=None): return self._agg("count", value, min_n, round)
    def median(self, value, min_n=None, round=None): return self._agg("median", value, min_n, round)
    def std(self, value, min_n=None, round=None): return self._agg("std", value, min_n, round)
    def var(self, value, min_n=None, round=None): return self._agg("var", value, min_n, round)


class PrivateSeriesGroups:
    def __init__(self, frame: PrivateFrame, by: list[str], value: str):
        self._frame, self._by, self._value = frame, by, value

    def _one(self, stat, min_n=None, round=None):
        from . import tables

        return tables.group_agg(self._frame, self._by, self._value, stat, min_n, round)

    def mean(self, min_n=None, round=None): return self._one("mean", min_n, round)
    def sum(self, min_n=None, round=None): return self._one("sum", min_n, round)
    def count(self, min_n=None, round=None): return self._one("count", min_n, round)
    def median(self, min_n=None, round=None): return self._one("median", min_n, round)
    def std(self, min_n=None, round=None): return self._one("std", min_n, round)
    def var(self, min_n=None, round=None): return self._one("var", min_n, round)
    def size(self, min_n=None, round=None): return self._one("size", min_n, round)

    def agg(self, stats, min_n=None, round=None):
        from . import tables

        if isinstance(stats, str):
            return self._one(R.check_stat(stats), min_n, round)
        if not isinstance(stats, (list, tuple)):
            raise DisclosureError("agg takes a statistic's name or a list of names")
        return tables.group_agg_multi(self._frame, self._by, self._value, [R.check_stat(s) for s in stats], min_n, round)

    aggregate = agg

    def describe(self):
        from . import tables

        return tables.group_describe(self._frame, self._by, self._value)

    def transform(self, stat) -> PrivateColumn:
        """The group's statistic on each row: the groups are aggregated and joined, so a large group
        is not in one task."""
        R.check_stat(stat)
        frame, name = self._frame, f"__h{next(_ids)}"
        v = F.col(f"`{self._value}`")
        value = R.aggregate(stat, v)
        known = frame._df
        for k in self._by:
            known = known.where(F.col(f"`{k}`").isNotNull())
        keys = [F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(self._by)]
        own = [c for c in (f"{name}_{i}" for i in range(len(self._by)))]
        if stat == "median":
            groups = grouped_quantiles(known.select(*keys, v.alias("v")), own, F.col("v"), [0.5], "m").select(*own, F.col("m")[0].alias(name))
        else:
            groups = known.groupBy(*keys).agg(value.alias(name))
        same = F.lit(True)
        for i, k in enumerate(self._by):
            same = same & (frame._df[f"`{k}`"] == groups[f"{name}_{i}"])
        frame._df = frame._df.join(groups, same, "left").drop(*[f"{name}_{i}" for i in range(len(self._by))])
        return PrivateColumn(frame, F.col(name), self._value)
