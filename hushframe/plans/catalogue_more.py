"""More of the engine's queries: column functions, measures, inference and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import DisclosureError
from ..operators.frame import PrivateFrame
from ..operators.models import panel, regression, survival
from ..operators.models.design import parse
from ..policy import resolve_policy
from ..session import run as run_script
from ..sources.tables import bind, load
from .catalogue import _KM, _ORDER, _spells, _treated, cells, flat, np, pd, query


def table(spark, rows: list[tuple], digits: int = 4):
    """idx, col, value from tuples of them."""
    return spark.createDataFrame([(str(i), str(c), None if v is None else round(float(v), digits)) for i, c, v in rows], "idx string, col string, value double")


def refused(make) -> float:
    try:
        make()
    except DisclosureError:
        return 1.0
    return 0.0


# ---------------------------------------------------------------- choice of columns

@query("SELECT 'c_acctbal' AS idx, '' AS col, round(avg(c_acctbal), 3) AS value FROM customer")
def choose_columns(spark, sf):
    """drop, select_dtypes, filter by name."""
    f = bind(spark, sf, "customer").drop(["c_name"]).select_dtypes("number").filter(like="acct")
    return flat(f.mean(), spark, 3)


@query("SELECT l_returnflag, round(sum(round_even(l_tax, 1) + round_even(l_discount, 1)), 3) AS value FROM lineitem GROUP BY 1")
def frame_round_astype(spark, sf):
    f = bind(spark, sf, "lineitem")[["l_returnflag", "l_tax", "l_discount"]].round(1).astype({"l_tax": "float"})
    return cells(f.assign(y=f.l_tax + f.l_discount).groupby("l_returnflag")["y"].sum(), 3)


@query("""SELECT unnest(['l_returnflag', 'l_tax', 'l_linestatus']) AS idx, unnest(['count', 'count', 'nunique']) AS col, unnest([CAST(count(l_returnflag) AS DOUBLE), CAST(count(l_tax) AS DOUBLE), CAST(count(DISTINCT l_linestatus) AS DOUBLE)]) AS value FROM lineitem""")
def frame_count_nunique(spark, sf):
    f = bind(spark, sf, "lineitem")[["l_returnflag", "l_tax", "l_linestatus"]]
    count, distinct = (dict(zip(r.payload["index"], r.payload["values"])) for r in (f.count(), f.nunique()))
    return table(spark, [("l_returnflag", "count", count["l_returnflag"]), ("l_tax", "count", count["l_tax"]), ("l_linestatus", "nunique", distinct["l_linestatus"])])


# ---------------------------------------------------------------- missing values and edits

@query("""WITH j AS (SELECT lang, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, 'missing' AS what, CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) AS value FROM j WHERE quality IS NULL GROUP BY 1
UNION ALL SELECT lang, 'known', CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) FROM j WHERE quality IS NOT NULL GROUP BY 1
UNION ALL SELECT lang, 'kept', CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) FROM j WHERE quality IS NOT NULL GROUP BY 1""")
def missing_values(spark, sf):
    """isna, notna, dropna."""
    f = bind(spark, sf, "documents").merge(bind(spark, sf, "labels"), on="doc_id", how="left")
    parts = [(f[f.quality.isna()], "missing"), (f[f.quality.notna()], "known"), (f.dropna(["quality"]), "kept")]
    out = [cells(g.groupby("lang").size()).withColumn("what", F.lit(w)) for g, w in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT lang, round(avg(coalesce(quality, -1) + CASE WHEN coalesce(toxic, 5) > 3 THEN 3 ELSE coalesce(toxic, 5) END), 4) AS value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 5""")
def frame_fillna_clip(spark, sf):
    f = bind(spark, sf, "documents").merge(bind(spark, sf, "labels"), on="doc_id", how="left")
    f = f.fillna({"quality": -1, "toxic": 5})[["lang", "quality", "toxic"]].clip(upper=3)
    return cells(f.assign(y=f.quality + f.toxic).groupby("lang")["y"].mean())


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def frame_replace(spark, sf):
    return cells(bind(spark, sf, "orders").replace({"o_orderstatus": {"F": "done"}}).groupby("o_orderstatus").size())


@query("""SELECT o_orderpriority, round(avg(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END) + avg(CASE WHEN o_totalprice > 100000 THEN 0 ELSE o_totalprice END) / 1000, 4) AS value FROM orders GROUP BY 1""")
def column_map_mask(spark, sf):
    f = bind(spark, sf, "orders")
    f = f.assign(s=f.o_orderstatus.map({"F": 1, "O": 2}), v=f.o_totalprice.mask(f.o_totalprice > 100000, 0) / 1000)
    a, b = (cells(f.groupby("o_orderpriority")[c].mean(), 9).withColumnRenamed("value", c) for c in ("s", "v"))
    return a.join(b, "o_orderpriority").select("o_orderpriority", F.round(F.col("s") + F.col("v"), 4).alias("value"))


@query("SELECT l_returnflag, round(avg(floor(l_quantity / 7) + abs(round_even(-l_discount, 1)) * 10 - (-l_tax)), 4) AS value FROM lineitem GROUP BY 1")
def column_arithmetic(spark, sf):
    """Floor division in an expression, negation, round, abs."""
    f = bind(spark, sf, "lineitem").assign("q", "l_quantity // 7")
    return cells(f.assign(y=f.q + (-f.l_discount).round(1).abs() * 10 - (-f.l_tax)).groupby("l_returnflag")["y"].mean())


# ---------------------------------------------------------------- order

def _along(name, make, sql):
    def run(spark, sf):
        f = bind(spark, sf, "events").sort_values(_ORDER)
        return cells(f.assign(y=make(f["value"])).groupby("event_type")["y"].mean(), 3)

    run.__name__ = f"ordered_{name}"
    query(f"SELECT event_type, round(avg(y), 3) AS value FROM ({sql}) GROUP BY 1")(run)


_ALONG = "FROM (SELECT *, CASE WHEN value > 50 THEN value END AS h, row_number() OVER (ORDER BY ts, event_id) AS p FROM events)"
_along("pct_change", lambda c: (c + 1).pct_change(), f"SELECT event_type, (value + 1) / (lag(value) OVER (ORDER BY p) + 1) - 1 AS y {_ALONG}")
_along("cumprod", lambda c: (c * 0 + 1.0001).cumprod(), f"SELECT event_type, pow(1.0001, p) AS y {_ALONG}")
_along("bfill", lambda c: c.where(c > 50).bfill(), f"SELECT event_type, first_value(h IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y {_ALONG}")
_along("interpolate", lambda c: c.where(c > 50).interpolate(), f"""SELECT event_type, coalesce(h, a + (b - a) * (p - pa) / (pb - pa), a) AS y FROM (SELECT event_type, h, p,
  last_value(h IGNORE NULLS) OVER (ORDER BY p) AS a, last_value(CASE WHEN h IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p) AS pa,
  first_value(h IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
  first_value(CASE WHEN h IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb {_ALONG})""")


# ---------------------------------------------------------------- text, dates, numbers

_NAME = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"


@query(f"""SELECT rpad({_NAME}, 12, '.') || lpad(CAST(length(c_mktsegment) AS VARCHAR), 4, '0') || '|' || {_NAME} || '|' || replace(c_mktsegment, 'A', '_') AS s, CAST(count(*) AS DOUBLE) AS value
FROM customer WHERE NOT ends_with(c_mktsegment, 'Y') AND strpos(c_mktsegment, 'U') > 1 GROUP BY 1""")
def text_cleaning(spark, sf):
    """title, capitalize, pad, zfill, strip, replace, endswith, find."""
    f = bind(spark, sf, "customer")
    f = f[~f.c_mktsegment.str.endswith("Y") & (f.c_mktsegment.str.find("U") > 0)]
    c = f.c_mktsegment.str
    padded = c.pad(16, side="both").str.strip().str.pad(20).str.lstrip().str.pad(20, side="right").str.rstrip()
    s = c.title().str.pad(12, side="right", fillchar=".").str.cat(c.len().astype("str").str.zfill(4)).str.cat(padded.str.capitalize(), sep="|").str.cat(c.replace("A", "_"), sep="|")
    return cells(f.assign(s=s).groupby("s").size())


@query("""SELECT event_type, round(avg(month(ts) + day(ts) / 100 + dayofyear(ts) * 10 + day(last_day(ts)) * 1000 + hour(ts) / 10 + minute(ts) / 7 + floor(second(ts)) / 3
  + CASE WHEN day(ts) = 1 THEN 50 ELSE 0 END + CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 70 ELSE 0 END), 3) AS value FROM events GROUP BY 1""")
def date_parts(spark, sf):
    f = bind(spark, sf, "events")
    d = f["ts"].dt
    y = d.month + d.day / 100 + d.dayofyear * 10 + d.days_in_month * 1000 + d.hour / 10 + d.minute / 7 + d.second / 3
    y = y + d.is_month_start.astype("int") * 50 + d.is_month_end.astype("int") * 70
    return cells(f.assign(y=y).groupby("event_type")["y"].mean(), 3)


@query("""SELECT l_returnflag, round(avg(exp(l_tax) + ln(1 + l_quantity) + log10(l_quantity) + log2(l_quantity) + cbrt(l_quantity) + sin(l_tax) + cos(l_tax) + tan(l_tax) + asin(l_tax) + acos(l_tax) + atan(l_tax) + radians(l_tax) + degrees(l_tax)
  + sinh(l_tax) + cosh(l_tax) + tanh(l_tax) + exp(l_tax) - 1 + sign(l_quantity - 25) + trunc(l_quantity / 3) + ceil(l_quantity / 3) + sqrt(l_tax * l_tax + 1) + greatest(l_tax, l_discount) + l_tax * l_tax + abs(l_quantity - 25)
  + CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END), 3) AS value FROM lineitem GROUP BY 1""")
def more_math(spark, sf):
    f = bind(spark, sf, "lineitem")
    q, t = f.l_quantity.astype("float"), f.l_tax
    y = np.exp(t) + np.log1p(q) + np.log10(q) + np.log2(q) + np.cbrt(q) + np.sin(t) + np.cos(t) + np.tan(t) + np.arcsin(t) + np.arccos(t) + np.arctan(t) + np.radians(t) + np.degrees(t)
    y = y + np.sinh(t) + np.cosh(t) + np.tanh(t) + np.expm1(t) + np.sign(q - 25) + np.trunc(q / 3) + np.ceil(q / 3) + np.hypot(t, 1) + np.maximum(t, f.l_discount) + np.square(t) + np.abs(q - 25)
    return cells(f.assign(y=y + np.where(q > 25, 1, -1)).groupby("l_returnflag")["y"].mean(), 3)


@query("""SELECT o_orderstatus, round(avg(year(o_orderdate) + CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)), 4) AS value FROM orders GROUP BY 1""")
def parse_values(spark, sf):
    """to_datetime and to_numeric of text; text that is neither is refused, or missing if asked."""
    f = bind(spark, sf, "orders")
    n = pd.to_numeric(f.o_orderpriority.str.slice(0, 1))
    if not refused(lambda: pd.to_numeric(f.o_orderpriority)) or not refused(lambda: pd.to_datetime(f.o_orderpriority)):
        raise AssertionError("text was taken for numbers or dates")
    gone = pd.to_numeric(f.o_orderpriority, errors="coerce").fillna(0)
    return cells(f.assign(y=pd.to_datetime(f.o_orderdate.astype("str")).dt.year + n + gone).groupby("o_orderstatus")["y"].mean())


@query("""WITH r AS (SELECT DISTINCT l_returnflag FROM lineitem), c AS (SELECT DISTINCT l_linestatus FROM lineitem), n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag AS idx, l_linestatus AS col, CAST(CASE WHEN n >= 5 THEN n END AS DOUBLE) AS value FROM r CROSS JOIN c LEFT JOIN n USING (l_returnflag, l_linestatus)""")
def crosstab_wide(spark, sf):
    f = bind(spark, sf, "lineitem")
    return flat(pd.crosstab(f.l_returnflag, f.l_linestatus), spark)


@query("SELECT event_type, round(avg(value), 4) AS value FROM events GROUP BY 1 HAVING count(*) >= 5 UNION ALL SELECT event_type, round(median(value), 4) FROM events GROUP BY 1 HAVING count(*) >= 5")
def group_by_name(spark, sf):
    """groupby().mean(column) and groupby().column.median()."""
    g = bind(spark, sf, "events").groupby("event_type")
    return cells(g.mean("value")).unionByName(cells(g.value.median()))


@query("""SELECT CASE WHEN x <= 0.5 THEN 'low' ELSE 'high' END AS half, CAST(count(*) AS DOUBLE) AS value FROM (SELECT l_tax * 10 AS x FROM lineitem UNION ALL SELECT l_discount * 10 FROM lineitem) GROUP BY 1""")
def stack_columns(spark, sf):
    """stack and unstack give the same values below each other where none is missing."""
    f = bind(spark, sf, "lineitem")[["l_tax", "l_discount"]]
    one, two = (cells(PrivateFrame(c._frame._df.select(np.where(c * 10 <= 0.5, "low", "high")._expr.alias("half")).withColumn("__rid", F.monotonically_increasing_id()), c.policy, ["half"]).groupby("half").size()) for c in (f.stack(), f.unstack(0)))
    if sorted(map(tuple, one.collect())) != sorted(map(tuple, two.collect())):
        raise AssertionError("stack and unstack differ")
    return one


# ---------------------------------------------------------------- measures

_SIG = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} / pow(10, floor(log10(abs({0}))) - 2), 0) * pow(10, floor(log10(abs({0}))) - 2) END"


@query("""SELECT s_nationkey, CASE WHEN count(*) >= 6 THEN CAST(count(*) AS DOUBLE) END AS value, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS DOUBLE) END AS least FROM supplier GROUP BY 1""")
def caller_tightens(spark, sf):
    """A caller's minimum counts if it is higher, and does not if it is lower."""
    g = bind(spark, sf, "supplier").groupby("s_nationkey")
    return cells(g.size(min_n=6)).join(cells(g.size(min_n=1)).withColumnRenamed("value", "least"), "s_nationkey")


@query(f"""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99]) AS p FROM lineitem)
SELECT unnest(['min', '25%', '50%', '75%', 'max']) AS idx, 'box' AS col, unnest(list_transform(p, lambda v: round({_SIG.format("v")}, 4))) AS value FROM q""")
def winsorised_box(spark, sf):
    """Ends are the winsorisation limits, and all are rounded to significant figures."""
    p = bind(spark, sf, "lineitem", "standard")["l_extendedprice"].boxplot().payload
    return table(spark, [(i, "box", v) for i, v in zip(p["x"], p["y"])])


@query("""SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS idx, '' AS col, unnest([CAST(count(l_quantity) AS DOUBLE), round(avg(l_quantity), 3), round(stddev_samp(l_quantity), 3),
  CAST(min(l_quantity) AS DOUBLE), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), CAST(max(l_quantity) AS DOUBLE)]) AS value FROM lineitem""")
def column_describe(spark, sf):
    return flat(bind(spark, sf, "lineitem")["l_quantity"].describe(), spark, 3)


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), w AS (SELECT least(greatest(l_extendedprice, lo), hi) AS x FROM lineitem, q)
SELECT unnest(['mean', 'sum', 'count', 'std']) AS idx, '' AS col, unnest([round_even(avg(x) / 10, 0) * 10, round_even(sum(x) / 10, 0) * 10, CAST(round_even(count(*) / 10, 0) * 10 AS DOUBLE), round_even(stddev_samp(x) / 10, 0) * 10]) AS value FROM w""")
def column_standard(spark, sf):
    """Whole-column statistics under the standard measures: winsorised, then rounded."""
    c = bind(spark, sf, "lineitem", "standard")["l_extendedprice"]
    return table(spark, [(s, "", getattr(c, s)().payload["value"]) for s in ("mean", "sum", "count", "std")])


@query("""SELECT unnest(['sparse counts', 'sparse grid', 'dense counts', 'edit of few', 'edit of all but few', 'edit of many', 'edit of none', 'length', 'truth', 'iteration', 'unknown column', 'function', 'positions']) AS idx, 'refused' AS col,
  CAST(unnest([1, 1, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1]) AS DOUBLE) AS value""")
def refusals(spark, sf):
    """What the measures and the private facade refuse."""
    o, n = bind(spark, sf, "orders", "standard"), bind(spark, sf, "lineitem", "standard")
    price = o.o_totalprice
    made = {
        "sparse counts": lambda: o.value_counts("o_orderkey").payload, "sparse grid": lambda: o.crosstab("o_orderkey", "o_orderstatus").payload, "dense counts": lambda: o.value_counts("o_orderstatus").payload,
        "edit of few": lambda: o.o_orderkey.replace(1, 0), "edit of all but few": lambda: o.o_orderkey.mask(o.o_orderkey != 1, 0), "edit of many": lambda: n.l_quantity.clip(upper=25), "edit of none": lambda: price.clip(lower=-1),
        "length": lambda: len(o), "truth": lambda: bool(price), "iteration": lambda: list(o), "unknown column": lambda: o["nothing"], "function": lambda: price.map(str), "positions": lambda: o.iloc,
    }
    return table(spark, [(k, "refused", refused(f)) for k, f in made.items()])


@query("""SELECT 'C(c_nationkey)[T.' || c_nationkey || ']' AS idx, 'shown' AS col, CAST(count(*) >= 5 AS DOUBLE) AS value FROM customer WHERE c_nationkey > (SELECT min(c_nationkey) FROM customer) GROUP BY c_nationkey""")
def model_term_support(spark, sf):
    """A factor's level that few rows have is blank in the summary."""
    p = regression.Smf().ols("c_acctbal ~ C(c_nationkey)", bind(spark, sf, "customer")).fit().summary().payload
    return table(spark, [(i, "shown", float(r[0] is not None)) for i, r in zip(p["index"], p["data"]) if i != "Intercept"])


@query("""WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1), j AS (SELECT s.*, c_nationkey FROM s JOIN customer USING (c_mktsegment))
SELECT c_mktsegment, round(avg(m), 4) AS value FROM j GROUP BY 1""")
def support_through_joins(spark, sf):
    """Group means joined back to the rows: enough rows stand behind each."""
    f = bind(spark, sf, "customer")
    s = f.summarise("c_mktsegment", m=("c_acctbal", "mean"))
    return cells(s.merge(f, on="c_mktsegment").groupby("c_mktsegment")["m"].mean())


@query("""SELECT c_nationkey, CAST(NULL AS DOUBLE) AS value FROM customer GROUP BY 1""")
def support_is_kept(spark, sf):
    """One row a customer stands behind each mean, however often a join repeats it."""
    f = bind(spark, sf, "customer")
    s = f.summarise(["c_custkey", "c_nationkey"], m=("c_acctbal", "mean"))
    many = s.merge(bind(spark, sf, "nation").rename({"n_nationkey": "c_nationkey"}), on="c_nationkey")
    return cells(many.melt(["c_nationkey"], ["m"]).groupby("c_nationkey")["value"].mean())


# ---------------------------------------------------------------- inference

def _tail(pdf: str, stat: str) -> str:
    """SQL for the integral of a density over x from ``stat`` up, by Simpson's rule on u = (x - stat) / (1 + x - stat)."""
    inner = f"SELECT i, i / 4000.0 AS u, {stat} + (i / 4000.0) / (1 - i / 4000.0) AS x FROM range(0, 4000) r(i)"
    return f"(SELECT sum(CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({pdf}) / ((1 - u) * (1 - u))) / 12000 FROM ({inner}))"


def _t_two_sided(t: str, df: str) -> str:
    pdf = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + x * x / {df}, -({df} + 1) / 2.0)"
    return f"2 * {_tail(pdf, f'abs({t})')}"


def _chi2(x: str, k: int) -> str:
    return _tail(f"exp(({k} / 2.0 - 1) * ln(greatest(x, 1e-300)) - x / 2 - {k} / 2.0 * ln(2) - lgamma({k} / 2.0))", x)


def _f_tail(stat: str, a: str, b: str) -> str:
    return _tail(f"exp({a} / 2.0 * ln({a} / ({b} * 1.0)) + ({a} / 2.0 - 1) * ln(greatest(x, 1e-300)) - ({a} + {b}) / 2.0 * ln(1 + {a} * x / ({b} * 1.0)) - lgamma({a} / 2.0) - lgamma({b} / 2.0) + lgamma(({a} + {b}) / 2.0))", stat)


@query(f"""WITH o AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v, count(*) AS n FROM lineitem),
one AS (SELECT (m - 25.6) / sqrt(v / n) AS t, n - 1 AS df FROM o),
g AS (SELECT l_linestatus, count(*) AS n, avg(l_tax) AS m, var_samp(l_tax) AS v FROM lineitem GROUP BY 1 ORDER BY 1),
p AS (SELECT list(m ORDER BY l_linestatus) AS m, list(v / n ORDER BY l_linestatus) AS s, list(n ORDER BY l_linestatus) AS n FROM g),
welch AS (SELECT (m[1] - m[2]) / sqrt(s[1] + s[2]) AS t, (s[1] + s[2]) * (s[1] + s[2]) / (s[1] * s[1] / (n[1] - 1) + s[2] * s[2] / (n[2] - 1)) AS df FROM p),
h AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), ht AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM orders),
an AS (SELECT (sum(h.n * (h.m - ht.m) * (h.m - ht.m)) / (count(*) - 1)) / (sum((h.n - 1) * h.v) / (any_value(ht.n) - count(*))) AS f, count(*) - 1 AS a, any_value(ht.n) - count(*) AS b FROM h, ht),
c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS y FROM c GROUP BY 1), tt AS (SELECT sum(n) AS n FROM c),
chi AS (SELECT sum((coalesce(c.n, 0) - x * y / tt.n) * (coalesce(c.n, 0) - x * y / tt.n) / (x * y / tt.n)) AS s FROM r CROSS JOIN k LEFT JOIN c USING (a, b), tt),
cr AS (SELECT corr(l_tax, l_discount) AS r, count(*) AS n FROM lineitem), ct AS (SELECT r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM cr)
SELECT 'one sample' AS idx, 'pvalue' AS col, round({_t_two_sided('t', 'df')}, 4) AS value FROM one
UNION ALL SELECT 'welch', 'pvalue', round({_t_two_sided('t', 'df')}, 4) FROM welch
UNION ALL SELECT 'anova', 'pvalue', round({_f_tail('f', 'a', 'b')}, 4) FROM an
UNION ALL SELECT 'chisq', 'pvalue', round({_chi2('s', 8)}, 4) FROM chi
UNION ALL SELECT 'pearson', 'pvalue', round({_t_two_sided('t', 'df')}, 4) FROM ct""")
def pvalues(spark, sf):
    l, o = bind(spark, sf, "lineitem"), bind(spark, sf, "orders")
    made = {"one sample": l.ttest("l_quantity", mu=25.6), "welch": l.ttest("l_tax", by="l_linestatus"), "anova": o.anova("o_totalprice", "o_orderstatus"), "chisq": o.chisq("o_orderpriority", "o_orderstatus"), "pearson": l.corr_test("l_tax", "l_discount")}
    return table(spark, [(k, "pvalue", r.payload["pvalue"]) for k, r in made.items()])


_Z = "1.959963984540054"
_CRIT = f"({_Z} + (pow({_Z}, 3) + {_Z}) / (4 * df) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96 * df * df))"
_OLS = """WITH m AS (SELECT count(*) AS n, avg({x}) AS mx, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy FROM {t}),
s AS (SELECT *, n - 2 AS df, (syy - b * b * sxx) / (n - 2) AS s2 FROM m), e AS (SELECT *, sqrt(s2 / sxx) AS se, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS sa FROM s)"""


@query(_OLS.format(x="l_tax", y="l_quantity", t="lineitem") + f"""
SELECT 'Intercept' AS idx, unnest(['coef', 'std_err', 'ci_low', 'ci_high', 'pvalue']) AS col, unnest([round(a, 4), round(sa, 4), round(a - {_CRIT} * sa, 4), round(a + {_CRIT} * sa, 4), round({_t_two_sided('(a / sa)', 'df')}, 4)]) AS value FROM e
UNION ALL SELECT 'l_tax', unnest(['coef', 'std_err', 'ci_low', 'ci_high', 'pvalue']), unnest([round(b, 4), round(se, 4), round(b - {_CRIT} * se, 4), round(b + {_CRIT} * se, 4), round({_t_two_sided('(b / se)', 'df')}, 4)]) FROM e""")
def ols_summary(spark, sf):
    """The whole summary, by keyword arguments."""
    return flat(bind(spark, sf, "lineitem").ols("l_quantity", ["l_tax"]), spark)


_TWO_BY_TWO = "WITH g AS (SELECT sum(e * o) AS a, sum((1 - e) * o) AS b, sum(e * (1 - o)) AS c, sum((1 - e) * (1 - o)) AS d FROM (SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS e, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS o FROM lineitem)), s AS (SELECT *, ln(a * d / (b * c)) AS beta, sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) AS se, a * b / (a + b) + c * d / (c + d) AS w, a + b + c + d AS n FROM g)"


@query(_TWO_BY_TWO + f""" SELECT 'logit' AS idx, unnest(['coef', 'std_err', 'ci_low', 'ci_high', 'margeff']) AS col, unnest([round(beta, 4), round(se, 4), round(beta - {_Z} * se, 4), round(beta + {_Z} * se, 4), round(beta * w / n, 4)]) AS value FROM s""")
def logit_summary(spark, sf):
    """Log odds ratio with its error and interval, and the average marginal effect."""
    f = bind(spark, sf, "lineitem")
    f = f.assign(e=(f.l_tax > 0.04).astype("int"))
    fitted = regression.Smf().logit("e ~ C(l_linestatus)", f).fit()
    p, m = fitted.summary().payload, fitted.margeff().payload
    row = dict(zip(p["columns"], p["data"][p["index"].index("C(l_linestatus)[T.O]")]))
    return table(spark, [("logit", c, row[c]) for c in ("coef", "std_err", "ci_low", "ci_high")] + [("logit", "margeff", m["data"][0][0])])


@query("""SELECT l_linestatus, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, 0.0 FROM lineitem GROUP BY 1
UNION ALL SELECT l_linestatus, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 4) FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, round(avg(l_linenumber), 4) FROM lineitem GROUP BY 1""")
def predictions(spark, sf):
    """With a factor as the only regressor the fitted values of each model are the factor's means, and residuals are zero on average."""
    f = bind(spark, sf, "lineitem")
    f = f.assign(e=(f.l_tax > 0.04).astype("int"))
    smf = regression.Smf()
    ols, logit, poisson = smf.ols("l_quantity ~ C(l_linestatus)", f).fit(), smf.logit("e ~ C(l_linestatus)", f).fit(), smf.poisson("l_linenumber ~ C(l_linestatus)", f).fit()
    out = [cells(f.assign(y=y).groupby("l_linestatus")["y"].mean()).withColumn("value", F.col("value") + 0.0) for y in (ols.fittedvalues, ols.resid, logit.predict(), poisson.predict())]
    return out[0].unionByName(out[1].withColumn("value", F.abs("value"))).unionByName(out[2]).unionByName(out[3])


_PANEL = _OLS.format(x="l_quantity", y="l_extendedprice", t="lineitem") + """,
u AS (SELECT l_suppkey, l_quantity - mx AS h, l_extendedprice - a - b * l_quantity AS u, sxx, n FROM lineitem, e), k AS (SELECT l_suppkey, sum(h * u) AS s, any_value(sxx) AS sxx FROM u GROUP BY 1),
hc AS (SELECT sqrt(any_value(n) / (any_value(n) - 2.0) * sum(h * h * u * u)) / any_value(sxx) AS se, sqrt(sum(h * h * u * u / (1 - 1.0 / n - h * h / sxx))) / any_value(sxx) AS h2, sqrt(sum(h * h * u * u / pow(1 - 1.0 / n - h * h / sxx, 2))) / any_value(sxx) AS h3 FROM u),
cr AS (SELECT sqrt(count(*) / (count(*) - 1.0) * sum(s * s)) / any_value(sxx) AS se FROM k)"""


@query(_PANEL + """ SELECT unnest(['iid', 'hetero', 'HC2', 'HC3', 'CRV1']) AS idx, 'std_err' AS col, unnest([round(e.se, 3), round(hc.se, 3), round(h2, 3), round(h3, 3), round(cr.se * sqrt((n - 1.0) / (n - 2)), 3)]) AS value FROM e, hc, cr""")
def panel_errors(spark, sf):
    """Standard errors of each kind."""
    f, model = bind(spark, sf, "lineitem"), parse("l_extendedprice ~ l_quantity", panel=True)
    rows = []
    for name, kind in (("iid", "iid"), ("hetero", "hetero"), ("HC2", "HC2"), ("HC3", "HC3"), ("CRV1", {"CRV1": "l_suppkey"})):
        p = panel.feols(f, model, kind).summary().payload
        rows.append((name, "std_err", dict(zip(p["columns"], p["data"][p["index"].index("l_quantity")]))["std_err"]))
    return table(spark, rows, 3)


@query("""WITH d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem)
SELECT 'l_quantity' AS idx, 'coef' AS col, round(sum(x * y) / sum(x * x), 3) AS value FROM d""")
def fixed_effects_by_name(spark, sf):
    return flat(bind(spark, sf, "lineitem").feols("l_extendedprice", ["l_quantity"], fe=["l_suppkey"]), spark, 3).where("col = 'coef'")


@query("""SELECT 'C(l_linestatus)[T.O]' AS idx, 'coef' AS col, round(ln(avg(l_quantity) FILTER (l_linestatus = 'O') / avg(l_quantity) FILTER (l_linestatus = 'F')), 4) AS value FROM lineitem""")
def fixed_effects_poisson(spark, sf):
    """Without effects, and with one that all rows share, it is the plain model."""
    f = bind(spark, sf, "lineitem")
    f = f.assign(one=1)
    out = [flat(panel.fepois(f, parse(m, panel=True)).summary(), spark).where("col = 'coef' and idx like 'C(%'") for m in ("l_quantity ~ C(l_linestatus)", "l_quantity ~ C(l_linestatus) | one")]
    if out[0].collect() != out[1].collect():
        raise AssertionError("an effect that all rows share changed the coefficient")
    return out[1]


def _cox_sql(steps: int = 7) -> str:
    """Newton's steps for one 0/1 covariate with Efron's ties, one CTE each."""
    sql = _KM.rstrip().rstrip(",") + """,
x AS (SELECT t, sum(d) FILTER (grp = 'F') AS d0, sum(d) FILTER (grp = 'O') AS d1, sum(c) FILTER (grp = 'F') AS c0, sum(c) FILTER (grp = 'O') AS c1 FROM c GROUP BY 1),
y AS (SELECT t, coalesce(d0, 0) AS d0, coalesce(d1, 0) AS d1, sum(coalesce(c0, 0)) OVER (ORDER BY t DESC) AS n0, sum(coalesce(c1, 0)) OVER (ORDER BY t DESC) AS n1 FROM x),
z AS (SELECT d1 / (d0 + d1) AS o, n0 - l / (d0 + d1) * d0 AS a, n1 - l / (d0 + d1) * d1 AS b FROM (SELECT *, unnest(range(0, CAST(d0 + d1 AS BIGINT))) AS l FROM y WHERE d0 + d1 > 0)),
b0 AS (SELECT 0.0 AS beta, 1.0 AS info)"""
    for k in range(steps):
        sql += f""",
b{k + 1} AS (SELECT any_value(beta) + sum(o - b * exp(beta) / (a + b * exp(beta))) / sum(b * exp(beta) / (a + b * exp(beta)) * a / (a + b * exp(beta))) AS beta, sum(b * exp(beta) / (a + b * exp(beta)) * a / (a + b * exp(beta))) AS info FROM z, b{k})"""
    return sql + f" SELECT 'C(l_linestatus)[T.O]' AS idx, unnest(['coef', 'std_err', 'hazard_ratio']) AS col, unnest([round(beta, 4), round(1 / sqrt(info), 4), round(exp(beta), 4)]) AS value FROM b{steps}"


@query(_cox_sql())
def cox_summary(spark, sf):
    return flat(_spells(spark, sf).cox("dur", "event", ["l_linestatus"]), spark).where("col in ('coef', 'std_err', 'hazard_ratio')")


@query("""WITH j AS (SELECT l_extendedprice AS y, l_quantity AS x, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'regression' AS idx, 'ate' AS col, round((covar_pop(t, y) * var_pop(x) - covar_pop(t, x) * covar_pop(x, y)) / (var_pop(t) * var_pop(x) - covar_pop(t, x) * covar_pop(t, x)), 3) AS value FROM j""")
def effect_by_regression(spark, sf):
    p = _treated(spark, sf).ate("l_extendedprice", "urgent", ["l_quantity"], "regression").payload
    return table(spark, [("regression", "ate", p["effect"])], 3)


_ARMS = """WITH j AS (SELECT l_extendedprice AS y, l_linestatus AS g, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, avg(t) OVER (PARTITION BY g) AS p FROM j)"""


def _arms(spark, sf) -> PrivateFrame:
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_extendedprice", "l_linestatus", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"))
    return PrivateFrame.bind(j, resolve_policy(suppression="light"))


@query(_ARMS + """, m AS (SELECT sum(t / p) AS s1, sum((1 - t) / (1 - p)) AS s0, sum(t / p * y) / sum(t / p) AS a, sum((1 - t) / (1 - p) * y) / sum((1 - t) / (1 - p)) AS b FROM k),
v AS (SELECT sum(t / p * t / p * (y - a) * (y - a)) / any_value(s1 * s1) + sum((1 - t) / (1 - p) * (1 - t) / (1 - p) * (y - b) * (y - b)) / any_value(s0 * s0) AS v FROM k, m)
SELECT 'weighting' AS idx, unnest(['effect', 'std_err']) AS col, unnest([round(a - b, 2), round(sqrt(v), 2)]) AS value FROM m, v""")
def effect_by_weighting(spark, sf):
    """With a factor as the only confounder the propensities are the factor's shares."""
    p = _arms(spark, sf).ate("l_extendedprice", "urgent", ["l_linestatus"], "weighting").payload
    return table(spark, [("weighting", c, p[c]) for c in ("effect", "std_err")], 2)


@query(_ARMS + " SELECT g AS l_linestatus, round(avg(t), 4) AS value FROM k GROUP BY 1")
def propensity(spark, sf):
    f = _arms(spark, sf)
    return cells(f.assign(p=f.propensity("urgent", ["l_linestatus"])).groupby("l_linestatus")["p"].mean())


@query(_KM.split("c AS")[0] + """c AS (SELECT t, sum(e) AS d, count(*) AS c FROM j GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY t DESC) AS n FROM c),
s AS (SELECT t, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE -1e9 END) OVER (ORDER BY t)) AS s FROM r)
SELECT 'median' AS idx, '' AS col, min(t) AS value FROM s WHERE s <= 0.5""")
def median_survival(spark, sf):
    f = _spells(spark, sf)
    return table(spark, [("median", "", survival.KaplanMeierFitter().fit(f.dur, event_observed=f.event).median_survival_time_.payload["value"])])


@query(_KM.split("c AS")[0].rstrip().rstrip(",").replace("AS e FROM", "AS e, CAST(l_quantity AS DOUBLE) AS x FROM") + """, m AS (SELECT count(*) AS n, avg(x) AS mx, regr_intercept(ln(t), x) AS a, regr_slope(ln(t), x) AS b, regr_sxx(ln(t), x) AS sxx, regr_syy(ln(t), x) AS syy FROM j), v AS (SELECT *, (syy - b * b * sxx) / n AS s2 FROM m)
SELECT unnest(['mu:Intercept', 'mu:l_quantity', 'log_sigma', 'mu:Intercept', 'mu:l_quantity', 'log_sigma']) AS idx, unnest(['coef', 'coef', 'coef', 'std_err', 'std_err', 'std_err']) AS col,
  unnest([round(a, 3), round(b, 3), round(ln(s2) / 2, 3), round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3), round(sqrt(s2 / sxx), 3), round(sqrt(0.5 / n), 3)]) AS value FROM v""")
def lognormal_times(spark, sf):
    """Where all times are seen to their end the model is least squares on their logarithms."""
    f = _spells(spark, sf)
    return flat(f.assign(event=1).lognormal_aft("dur", "event", ["l_quantity"]), spark, 3).where("col in ('coef', 'std_err')")


# ---------------------------------------------------------------- scripts

def _script(spark, sf, code: str, name: str = "lineitem", suppression: str = "light"):
    return run_script(code, {"df": load(spark, sf, name)}, suppression=suppression)


@query("""SELECT 'mean' AS idx, l_returnflag AS col, round(avg(l_tax), 4) AS value FROM lineitem WHERE l_quantity > 10 GROUP BY 2
UNION ALL SELECT 'count', l_returnflag, CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity > 10 GROUP BY 2 UNION ALL SELECT 'results', '', 2.0""")
def script_results(spark, sf):
    """A script's bare expressions are its results, in order."""
    r = _script(spark, sf, "import numpy as np\nbig = df[df.l_quantity > 10]\nbig.groupby('l_returnflag')['l_tax'].mean()\nbig.value_counts('l_returnflag')")
    first, second = (x.payload for x in r.results)
    return table(spark, [("mean", i, v) for i, v in zip(first["index"], first["values"])] + [("count", i, v) for i, v in zip(second["index"], second["values"])] + [("results", "", len(r.results))])


_BAD = {
    "rows": "df", "a column": "df.l_tax", "an attribute": "df.__class__", "an import": "import os", "a call": "open('x')", "a lambda": "df.l_tax.map(lambda v: v)", "a loop": "for x in df: x", "a string method": "'{0.__class__}'.format(df)",
    "an error": "1 / 0", "a comprehension": "[x for x in df]", "head": "df.head()", "a dunder name": "__builtins__", "a del": "del df", "a with": "with df: df",
}


@query("SELECT unnest([" + ", ".join(f"'{k}'" for k in _BAD) + "]) AS idx, unnest([" + ", ".join("'disclosure'" if k in ("rows", "a column") else "'runtime'" if k == "an error" else "'gate'" for k in _BAD) + "]) AS col, CAST(0 AS DOUBLE) AS value")
def script_refusals(spark, sf):
    """Which barrier stops a script: the gate, the run, or the exit."""
    kind = {"disclosure": "disclosure", "runtime": "runtime"}
    out = []
    for name, code in _BAD.items():
        r = _script(spark, sf, code, "nation")
        out.append((name, kind.get((r.error or {}).get("kind"), "gate"), float(r.ok)))
    return table(spark, out)


@query("""SELECT 'n_rows' AS idx, 'small' AS col, CAST(count(*) AS DOUBLE) AS value FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'n_missing', 's_acctbal', 0.0 UNION ALL SELECT 'n_columns', 'small', 4.0 UNION ALL SELECT 'frames', '', 2.0""")
def script_catalog(spark, sf):
    """Names, types and counts of the frames that a script leaves."""
    r = _script(spark, sf, "small = df[df.s_acctbal > 0]\nsmall['s_acctbal'].mean()", "supplier")
    entry = {e["name"]: e for e in r.catalog}["small"]
    return table(spark, [("n_rows", "small", entry["n_rows"]), ("n_missing", "s_acctbal", {c["name"]: c["n_missing"] for c in entry["columns"]}["s_acctbal"]), ("n_columns", "small", entry["n_columns"]), ("frames", "", len(r.catalog))])


@query("""SELECT l_returnflag AS idx, 'bar' AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1""")
def charts(spark, sf):
    """A chart is drawn from released values only, in each form."""
    released = bind(spark, sf, "lineitem").value_counts("l_returnflag").plot.bar().payload
    for form in ("svg", "ascii", "html"):
        drawn = run_script("df.value_counts('l_returnflag').plot.bar()", {"df": load(spark, sf, "lineitem")}, suppression="light", render=form).payload["data"]
        if any(str(x) not in drawn for x in released["x"]):
            raise AssertionError(f"the {form} chart lacks a label")
    return table(spark, [(x, released["kind"], y) for x, y in zip(released["x"], released["y"])])
