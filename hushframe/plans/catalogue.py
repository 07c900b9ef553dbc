"""The engine's queries on the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.namespaces import Np, Pd
from ..operators import release as R
from ..operators import tables as T
from ..operators import verbs  # noqa: F401  binds the statistical verbs to frames
from ..operators.frame import PrivateFrame
from ..operators.models import panel, regression, survival
from ..operators.models.design import parse
from ..policy import PRESETS, resolve_policy
from ..sources.tables import bind, load
from ..streaming import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

np, pd = Np(), Pd()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(released: R.Released, spark: SparkSession, digits: int = 4) -> DataFrame:
    """A released result as rows: index, column, value."""
    p = released.payload
    if p["type"] == "scalar":
        rows = [("", "", p["value"])]
    elif p["type"] == "series":
        rows = [(i, "", v) for i, v in zip(p["index"], p["values"])]
    elif p["type"] == "frame":
        rows = [(i, c, v) for i, r in zip(p["index"], p["data"]) for c, v in zip(p["columns"], r)]
    else:
        rows = [("", k, v) for k, v in p.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    rows = [(str(i), str(c), None if v is None else round(float(v), digits)) for i, c, v in rows]
    return spark.createDataFrame(rows, "idx string, col string, value double")


def cells(released: R.Released, digits: int = 4) -> DataFrame:
    """The released frame itself, numbers rounded for comparison."""
    df = released.frame
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def per_key(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


# ---------------------------------------------------------------- grouped aggregates

@query("""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
a AS (SELECT l_returnflag, count(*) AS n, avg(least(greatest(l_extendedprice, lo), hi)) AS m FROM lineitem, b
  WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)
SELECT l_returnflag, CASE WHEN n >= 10 THEN round_even(m / 10, 0) * 10 END AS value FROM a""")
def group_mean_standard(spark, sf):
    return cells(bind(spark, sf, "lineitem", "standard").groupby("l_returnflag")["l_extendedprice"].mean())


_SQL_STAT = {"mean": "avg(value)", "sum": "sum(value)", "count": "count(value)", "size": "count(*)", "median": "median(value)", "std": "stddev_samp(value)", "var": "var_samp(value)"}


def _group_stat(stat):
    def run(spark, sf):
        groups = bind(spark, sf, "events").groupby("event_type")["value"]
        return cells(getattr(groups, stat)(), 2)

    run.__name__ = f"group_{stat}"
    query(f"SELECT event_type, round(CASE WHEN count(*) >= 5 THEN CAST({_SQL_STAT[stat]} AS DOUBLE) END, 2) AS value FROM events GROUP BY event_type")(run)


for _stat in R.STATS:
    _group_stat(_stat)


@query("SELECT s_nationkey, round(CASE WHEN count(*) >= 5 THEN avg(s_acctbal) END, 4) AS value FROM supplier GROUP BY s_nationkey")
def group_suppressed(spark, sf):
    return cells(bind(spark, sf, "supplier").groupby("s_nationkey")["s_acctbal"].mean())


@query("SELECT l_returnflag, l_linestatus, CAST(round_even(count(*) / 10.0, 0) * 10 AS DOUBLE) AS value FROM lineitem GROUP BY ALL")
def group_two_keys(spark, sf):
    return cells(bind(spark, sf, "lineitem", "standard").groupby(["l_returnflag", "l_linestatus"]).size())


@query("SELECT event_type, round(avg(value), 4) AS mean, CAST(count(value) AS DOUBLE) AS count, round(median(value), 4) AS median FROM events GROUP BY event_type HAVING count(*) >= 5")
def group_many(spark, sf):
    return cells(bind(spark, sf, "events").groupby("event_type")["value"].agg(["mean", "count", "median"]))


@query("""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS p, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1),
k AS (SELECT l.l_returnflag, count(*) FILTER (l_extendedprice <= p[1]) AS lo, count(*) FILTER (l_extendedprice >= p[5]) AS hi FROM lineitem l JOIN q USING (l_returnflag) GROUP BY 1)
SELECT q.l_returnflag, CAST(n AS DOUBLE) AS count, round(m, 4) AS mean, round(s, 4) AS std,
  round(CASE WHEN lo >= 5 THEN p[1] END, 4) AS "min", round(p[2], 4) AS "25%", round(p[3], 4) AS "50%", round(p[4], 4) AS "75%", round(CASE WHEN hi >= 5 THEN p[5] END, 4) AS "max"
FROM q JOIN k USING (l_returnflag)""")
def group_describe(spark, sf):
    return cells(bind(spark, sf, "lineitem").groupby("l_returnflag")["l_extendedprice"].describe())


# ---------------------------------------------------------------- frequency tables

@query("SELECT c_mktsegment, CAST(round_even(count(*) / 10.0, 0) * 10 AS DOUBLE) AS count FROM customer GROUP BY 1")
def value_counts(spark, sf):
    return cells(bind(spark, sf, "customer", "standard").value_counts("c_mktsegment"))


@query("SELECT s_nationkey, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS DOUBLE) END AS count FROM supplier GROUP BY 1")
def value_counts_suppressed(spark, sf):
    return cells(bind(spark, sf, "supplier").value_counts("s_nationkey"))


@query("""
SELECT event_type, CAST(greatest(0, count(*) + (('0x' || substr(sha256('fixture|' || length(event_type) || '|' || event_type), 1, 15))::BIGINT % 5) - 2) AS DOUBLE) AS count
FROM events GROUP BY event_type""")
def value_counts_noise(spark, sf):
    return cells(bind(spark, sf, "events", replace(PRESETS["microdata"], noise_key="fixture")).value_counts("event_type"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS count FROM lineitem GROUP BY ALL")
def crosstab(spark, sf):
    return T.crosstab_long(bind(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1""")
def pivot_table(spark, sf):
    return cells(bind(spark, sf, "orders").pivot_table("o_totalprice", "o_orderpriority", "o_orderstatus", "mean"), 2)


@query("""SELECT CAST(ceil(l_quantity / 5) - 1 AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def histogram(spark, sf):
    return T.histogram_long(bind(spark, sf, "lineitem")["l_quantity"], [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50])[0]


# ---------------------------------------------------------------- whole columns and frames

@query("""
SELECT unnest(['mean','sum','count','median','std','var','sem','skew','kurt','nunique']) AS idx, '' AS col,
  unnest([round(avg(value), 4), round(sum(value), 4), CAST(count(value) AS DOUBLE), round(median(value), 4), round(stddev_samp(value), 4), round(var_samp(value), 4),
  round(stddev_samp(value) / sqrt(count(value)), 4), round(skewness(value), 4), round(kurtosis(value), 4), CAST(count(DISTINCT value) AS DOUBLE)]) AS value FROM events""")
def column_statistics(spark, sf):
    c = bind(spark, sf, "events")["value"]
    rows = [(s, "", round(getattr(c, s)().payload["value"], 4)) for s in ("mean", "sum", "count", "median", "std", "var", "sem", "skew", "kurt", "nunique")]
    return spark.createDataFrame(rows, "idx string, col string, value double")


@query("""SELECT unnest(['q_min','q_max','p_min','p_max','q25']) AS idx, '' AS col, unnest([CAST(min(l_quantity) AS DOUBLE), CAST(max(l_quantity) AS DOUBLE), NULL, NULL, CAST(quantile_cont(l_quantity, 0.25) AS DOUBLE)]) AS value FROM lineitem""")
def order_statistics(spark, sf):
    """Extremes that many rows share are shown, single ones are not."""
    f = bind(spark, sf, "lineitem")
    q, p = f["l_quantity"], f["l_extendedprice"]
    rows = [("q_min", q.min()), ("q_max", q.max()), ("p_min", p.min()), ("p_max", p.max()), ("q25", q.quantile(0.25))]
    return spark.createDataFrame([(n, "", r.payload["value"]) for n, r in rows], "idx string, col string, value double")


@query("SELECT unnest(['l_quantity','l_discount','l_tax']) AS idx, '' AS col, unnest([round(avg(l_quantity), 3), round(avg(l_discount), 3), round(avg(l_tax), 3)]) AS value FROM lineitem")
def frame_mean(spark, sf):
    return flat(bind(spark, sf, "lineitem")[["l_quantity", "l_discount", "l_tax"]].mean(), spark, 3)


@query("""SELECT unnest(['count','mean','std','min','25%','50%','75%','max']) AS idx, 'l_quantity' AS col, unnest([CAST(count(l_quantity) AS DOUBLE), round(avg(l_quantity), 3), round(stddev_samp(l_quantity), 3),
  CAST(min(l_quantity) AS DOUBLE), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), CAST(max(l_quantity) AS DOUBLE)]) AS value FROM lineitem""")
def frame_describe(spark, sf):
    return flat(bind(spark, sf, "lineitem")[["l_quantity"]].describe(), spark, 3)


def _matrix_sql(f):
    own = ("l_quantity", "l_extendedprice", "l_discount")
    parts = " UNION ALL ".join(f"SELECT '{a}' AS idx, '{b}' AS col, round({f}({a}, {b}), 3) AS value FROM lineitem" for a in own for b in own)
    return parts


@query(_matrix_sql("corr"))
def correlation(spark, sf):
    return flat(bind(spark, sf, "lineitem")[["l_quantity", "l_extendedprice", "l_discount"]].corr(), spark)


@query(_matrix_sql("covar_samp"))
def covariance(spark, sf):
    return flat(bind(spark, sf, "lineitem")[["l_quantity", "l_extendedprice", "l_discount"]].cov(), spark)


# ---------------------------------------------------------------- filters and transforms

@query("SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_quantity > 10 AND NOT coalesce(l_tax = 0, false) AND l_discount BETWEEN 0.02 AND 0.06 AND l_linenumber IN (1, 2, 3) GROUP BY 1")
def filters(spark, sf):
    f = bind(spark, sf, "lineitem")
    f = f[(f.l_quantity > 10) & ~(f.l_tax == 0) & f.l_discount.between(0.02, 0.06) & f.l_linenumber.isin([1, 2, 3])]
    return cells(f.groupby("l_returnflag").size())


@query("SELECT CAST(quality AS VARCHAR) AS quality, CAST(count(*) AS DOUBLE) AS value FROM documents LEFT JOIN labels USING (doc_id) WHERE quality <> 0 OR quality IS NULL GROUP BY 1 HAVING CAST(quality AS VARCHAR) IS NOT NULL")
def missing_is_not_equal(spark, sf):
    """A comparison with a missing value is false, and != is true."""
    f = bind(spark, sf, "documents").merge(bind(spark, sf, "labels"), on="doc_id", how="left")
    f = f[f.quality != 0]
    return cells(f.assign(quality=f.quality.astype("str")).groupby("quality").size())


@query("SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def where_pushed_down(spark, sf):
    import datetime

    return cells(bind(spark, sf, "lineitem").where("l_shipdate", ">=", datetime.datetime(1998, 1, 1)).groupby("l_returnflag").size())


@query("SELECT event_type, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM events GROUP BY 1")
def drop_duplicates(spark, sf):
    return cells(bind(spark, sf, "events").drop_duplicates(["event_type", "user_id"]).groupby("event_type").size())


@query("SELECT l_returnflag, round(avg(ln(l_quantity) + CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END + (l_linenumber % 3) + pow(l_discount, 2)), 4) AS value FROM lineitem GROUP BY 1")
def assign_expression(spark, sf):
    f = bind(spark, sf, "lineitem").assign("y", "log(l_quantity) + where(l_tax > 0.05, 1, 0) + l_linenumber % 3 + l_discount ** 2")
    return cells(f.groupby("l_returnflag")["y"].mean())


@query("SELECT l_returnflag, round(avg(sqrt(l_quantity) + least(l_tax, l_discount) + floor(l_extendedprice / 1000) + atan2(l_tax, 1) + round_even(l_tax, 1)), 4) AS value FROM lineitem GROUP BY 1")
def math_functions(spark, sf):
    f = bind(spark, sf, "lineitem")
    y = np.sqrt(f.l_quantity) + np.minimum(f.l_tax, f.l_discount) + np.floor(f.l_extendedprice / 1000) + np.arctan2(f.l_tax, 1) + np.round(f.l_tax, 1)
    return cells(f.assign(y=y).groupby("l_returnflag")["y"].mean())


@query("""SELECT upper(substr(c_mktsegment, 1, 3)) || '-' || lower(substr(c_mktsegment, 2, 2)) AS s, CAST(count(*) AS DOUBLE) AS value
FROM customer WHERE contains(c_mktsegment, 'E') AND NOT starts_with(c_mktsegment, 'M') AND length(c_mktsegment) > 5 GROUP BY 1""")
def text_functions(spark, sf):
    f = bind(spark, sf, "customer")
    c = f["c_mktsegment"]
    f = f[c.str.contains("E") & ~c.str.startswith("M") & (c.str.len() > 5)]
    c = f["c_mktsegment"]
    return cells(f.assign(s=c.str.slice(0, 3).str.upper().str.cat(c.str.substr(1, 2).str.lower(), sep="-")).groupby("s").size())


@query("""SELECT year(o_orderdate) * 100 + quarter(o_orderdate) * 10 + (isodow(o_orderdate) - 1) AS k, CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) AS value FROM orders GROUP BY 1""")
def date_functions(spark, sf):
    f = bind(spark, sf, "orders")
    d = f["o_orderdate"].dt
    out = cells(f.assign(k=d.year * 100 + d.quarter * 10 + d.weekday).groupby("k").size())
    return out.withColumn("k", F.col("k").cast("long"))


@query("SELECT l_returnflag, round(avg(floor(epoch(l_shipdate - o_orderdate) / 86400)), 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def date_difference(spark, sf):
    l = bind(spark, sf, "lineitem").rename({"l_orderkey": "k"})
    f = l.merge(bind(spark, sf, "orders").rename({"o_orderkey": "k"}), on="k")
    return cells(f.assign(d=(f.l_shipdate - f.o_orderdate).dt.days).groupby("l_returnflag")["d"].mean())


@query("SELECT CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'mid' ELSE 'high' END AS band, CAST(count(*) AS DOUBLE) AS value FROM part WHERE p_size > 0 AND p_size <= 50 GROUP BY 1")
def cut(spark, sf):
    f = bind(spark, sf, "part")
    return cells(f.assign(band=pd.cut(f.p_size, [0, 10, 30, 50], labels=["low", "mid", "high"])).groupby("band").size())


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 'q1' WHEN o_totalprice <= q[2] THEN 'q2' WHEN o_totalprice <= q[3] THEN 'q3' ELSE 'q4' END AS band, CAST(count(*) AS DOUBLE) AS value FROM orders, e GROUP BY 1""")
def qcut(spark, sf):
    f = bind(spark, sf, "orders")
    return cells(f.assign(band=pd.qcut(f.o_totalprice, 4)).groupby("band").size())


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, round(avg(least(greatest(o_totalprice, 50000), 300000)), 4) AS value FROM orders GROUP BY 1""")
def edits(spark, sf):
    f = bind(spark, sf, "orders")
    f = f.assign(s=f.o_orderstatus.replace({"F": "done", "O": "open", "P": "part"}), v=f.o_totalprice.clip(50000, 300000))
    return cells(f.groupby("s")["v"].mean())


# ---------------------------------------------------------------- joins, reshapes, order

@query("""SELECT r_name, round(avg(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def merge_inner(spark, sf):
    f = bind(spark, sf, "orders").rename({"o_custkey": "c_custkey"}).merge(bind(spark, sf, "customer"), on="c_custkey")
    f = f.rename({"c_nationkey": "n_nationkey"}).merge(bind(spark, sf, "nation"), on="n_nationkey")
    f = f.rename({"n_regionkey": "r_regionkey"}).merge(bind(spark, sf, "region"), on="r_regionkey")
    return cells(f.groupby("r_name")["o_totalprice"].mean(), 2)


def _outer(how):
    def run(spark, sf):
        f = bind(spark, sf, "documents").merge(bind(spark, sf, "labels"), on="doc_id", how=how)
        lang, quality = f.lang.fillna("none"), f.quality.fillna(9)
        return cells(f.assign(g=lang.str.cat(quality.astype("str"), "/")).groupby("g").size())

    run.__name__ = f"merge_{how}"
    sql = {"left": "LEFT", "right": "RIGHT", "outer": "FULL"}[how]
    query(f"""SELECT coalesce(lang, 'none') || '/' || CAST(coalesce(quality, 9) AS VARCHAR) AS g, CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) AS value
FROM documents {sql} JOIN labels USING (doc_id) GROUP BY 1""")(run)


for _how in ("left", "right", "outer"):
    _outer(_how)


@query("SELECT round(avg(m), 4) AS value, '' AS idx, '' AS col FROM (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 1)")
def summarise(spark, sf):
    return flat(bind(spark, sf, "lineitem").summarise("l_suppkey", m=("l_quantity", "mean"))["m"].mean(), spark)


@query("SELECT variable, round(avg(value), 4) AS value FROM (UNPIVOT (SELECT l_quantity, CAST(l_tax AS DOUBLE) AS l_tax FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_tax FROM lineitem)) ON l_quantity, l_tax INTO NAME variable VALUE value) GROUP BY 1")
def melt(spark, sf):
    return cells(bind(spark, sf, "lineitem").melt(["l_returnflag"], ["l_quantity", "l_tax"]).groupby("variable")["value"].mean())


@query("""SELECT round(avg(F), 4) AS value, '' AS idx, '' AS col FROM (SELECT c_nationkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS F FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""")
def pivot(spark, sf):
    f = bind(spark, sf, "orders").rename({"o_custkey": "c_custkey"}).merge(bind(spark, sf, "customer"), on="c_custkey")
    return flat(f.summarise(["c_nationkey", "o_orderstatus"], v=("o_totalprice", "mean")).pivot("c_nationkey", "o_orderstatus", "v")["F"].mean(), spark)


@query("SELECT label, round(avg(x), 4) AS value FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def explode(spark, sf):
    return cells(bind(spark, sf, "embeddings").explode("embedding").groupby("label")["embedding"].mean())


@query("SELECT event_type, round(avg(value - m), 4) + 0 AS value FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def transform(spark, sf):
    f = bind(spark, sf, "events")
    f = f.assign(d=f.value - f.groupby("user_id")["value"].transform("mean"))
    out = cells(f.groupby("event_type")["d"].mean())
    return out.withColumn("value", F.col("value") + 0.0)


_ORDER = ["ts", "event_id"]


def _ordered(name, make, sql):
    def run(spark, sf):
        f = bind(spark, sf, "events").sort_values(_ORDER)
        return cells(f.assign(y=make(f["value"])).groupby("event_type")["y"].mean(), 3)

    run.__name__ = f"ordered_{name}"
    query(f"SELECT event_type, round(avg(y), 3) AS value FROM (SELECT event_type, {sql} AS y FROM (SELECT *, CASE WHEN value > 50 THEN value END AS h FROM events) WINDOW w AS (ORDER BY ts, event_id)) GROUP BY 1")(run)


_ordered("shift", lambda c: c.shift(2), "lag(value, 2) OVER w")
_ordered("diff", lambda c: c.diff(), "value - lag(value) OVER w")
_ordered("cumsum", lambda c: c.cumsum() / 1000, "sum(value) OVER w / 1000")
_ordered("cummax", lambda c: c.cummax(), "max(value) OVER w")
_ordered("cummin", lambda c: c.cummin(), "min(value) OVER w")
_ordered("ffill", lambda c: c.where(c > 50).ffill(), "last_value(h IGNORE NULLS) OVER w")


# ---------------------------------------------------------------- tests and models

@query("""WITH g AS (SELECT l_linestatus, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1 ORDER BY 1),
p AS (SELECT list(m ORDER BY l_linestatus) AS m, list(v / n ORDER BY l_linestatus) AS s FROM g)
SELECT '' AS idx, 'statistic' AS col, round((m[1] - m[2]) / sqrt(s[1] + s[2]), 4) AS value FROM p""")
def welch_test(spark, sf):
    return flat(bind(spark, sf, "lineitem").ttest("l_quantity", by="l_linestatus"), spark).where("col = 'statistic'")


@query("""WITH t AS (SELECT avg(l_quantity) AS m, count(*) AS n FROM lineitem), g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT '' AS idx, 'statistic' AS col, round((sum(g.n * (g.m - t.m) * (g.m - t.m)) / (count(*) - 1)) / (sum((g.n - 1) * g.v) / (any_value(t.n) - count(*))), 4) AS value FROM g, t""")
def anova(spark, sf):
    return flat(bind(spark, sf, "lineitem").anova("l_quantity", "l_returnflag"), spark).where("col = 'statistic'")


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS y FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c)
SELECT '' AS idx, 'statistic' AS col, round(sum((c.n - x * y / t.n) * (c.n - x * y / t.n) / (x * y / t.n)), 4) AS value FROM c JOIN r USING (a) JOIN k USING (b), t""")
def chi_square(spark, sf):
    return flat(bind(spark, sf, "lineitem").chisq("l_returnflag", "l_linestatus"), spark).where("col = 'statistic'")


@query("""WITH r AS (SELECT l_linestatus, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem)
SELECT '' AS idx, 'statistic' AS col, round(sum(r) - count(*) * (count(*) + 1) / 2.0, 4) AS value FROM r WHERE l_linestatus = (SELECT min(l_linestatus) FROM lineitem)""")
def mann_whitney(spark, sf):
    return flat(bind(spark, sf, "lineitem").mannwhitney("l_quantity", "l_linestatus"), spark).where("col = 'statistic'")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT '' AS idx, 'statistic' AS col, round(corr(a, b), 4) AS value FROM r""")
def spearman(spark, sf):
    return flat(bind(spark, sf, "lineitem").corr_test("l_quantity", "l_extendedprice", method="spearman"), spark).where("col = 'statistic'")


@query("SELECT unnest(['Intercept', 'l_quantity']) AS idx, 'coef' AS col, unnest([round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_slope(l_extendedprice, l_quantity), 3)]) AS value FROM lineitem")
def ols(spark, sf):
    return flat(regression.Smf().ols("l_extendedprice ~ l_quantity", bind(spark, sf, "lineitem")).fit().summary(), spark, 3).where("col = 'coef'")


@query("""SELECT 'l_linestatus' AS idx, 'coef' AS col, round(ln(sum(e * o) * sum((1 - e) * (1 - o)) / (sum(e * (1 - o)) * sum((1 - e) * o))), 4) AS value
FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS o FROM lineitem)""")
def logit(spark, sf):
    """With one 0/1 regressor the coefficient is the log odds ratio."""
    f = bind(spark, sf, "lineitem")
    f = f.assign(e=(f.l_returnflag == "R").astype("int"), l_linestatus=f.l_linestatus)
    return flat(regression.Smf().logit("e ~ C(l_linestatus)", f).fit().summary(), spark).where("col = 'coef' and idx like 'C(%'").withColumn("idx", F.lit("l_linestatus"))


@query("""SELECT 'l_linestatus' AS idx, 'coef' AS col, round(ln(avg(l_quantity) FILTER (l_linestatus = 'O') / avg(l_quantity) FILTER (l_linestatus = 'F')), 4) AS value FROM lineitem""")
def poisson(spark, sf):
    return flat(regression.Smf().poisson("l_quantity ~ C(l_linestatus)", bind(spark, sf, "lineitem")).fit().summary(), spark).where("col = 'coef' and idx like 'C(%'").withColumn("idx", F.lit("l_linestatus"))


@query("""WITH d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem)
SELECT 'l_quantity' AS idx, 'coef' AS col, round(sum(x * y) / sum(x * x), 3) AS value FROM d""")
def fixed_effects(spark, sf):
    return flat(panel.feols(bind(spark, sf, "lineitem"), parse("l_extendedprice ~ l_quantity | l_suppkey", panel=True), {"CRV1": "l_suppkey"}).summary(), spark, 3).where("col = 'coef'")


@query("""SELECT 'l_discount' AS idx, 'coef' AS col, round(covar_samp(l_extendedprice, l_linenumber) / covar_samp(l_discount, l_linenumber), 0) AS value FROM lineitem""")
def instrumental(spark, sf):
    return flat(panel.feols(bind(spark, sf, "lineitem"), parse("l_extendedprice ~ 1 | 0 | l_discount ~ l_linenumber", panel=True), "hetero").summary(), spark, 0).where("col = 'coef' and idx = 'l_discount'")


def _spells(spark, sf) -> PrivateFrame:
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_linestatus", (F.abs(F.datediff("l_shipdate", "o_orderdate")) + 1).alias("dur"), (F.col("l_returnflag") == "R").cast("int").alias("event"), "l_quantity")
    return PrivateFrame.bind(j, resolve_policy(suppression="light"))


_KM = """
WITH j AS (SELECT l_linestatus AS grp, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) + 1 AS DOUBLE) AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT grp, t, sum(e) AS d, count(*) AS c FROM j GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY t DESC) AS n FROM c),
s AS (SELECT *, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE -1e9 END) OVER (PARTITION BY grp ORDER BY t)) AS s FROM r)
"""


@query(_KM + "SELECT grp, t, round(s, 6) AS survival FROM s WHERE n >= 5")
def kaplan_meier(spark, sf):
    out = survival.released_curve(_spells(spark, sf), "dur", "event", "l_linestatus")
    return out.select("grp", "t", F.round("survival", 6).alias("survival"))


@query(_KM + """, a AS (SELECT grp, t, s, least(lead(t) OVER (PARTITION BY grp ORDER BY t), 365) AS u, row_number() OVER (PARTITION BY grp ORDER BY t) AS k FROM s)
SELECT grp, round(sum(greatest(coalesce(u, 365) - t, 0) * s + CASE WHEN k = 1 THEN least(t, 365) ELSE 0 END), 4) AS rmst FROM a GROUP BY 1""")
def restricted_mean(spark, sf):
    return survival.rmst_table(_spells(spark, sf), "dur", "event", 365, "l_linestatus").select("grp", F.round("rmst", 4).alias("rmst"))


@query(_KM + """, w AS (SELECT t, sum(d) FILTER (grp = 'F') AS d0, sum(d) AS d, sum(c) FILTER (grp = 'F') AS c0, sum(c) AS c FROM c GROUP BY 1),
n AS (SELECT t, coalesce(d0, 0) AS d0, d, sum(coalesce(c0, 0)) OVER (ORDER BY t DESC) AS n0, sum(c) OVER (ORDER BY t DESC) AS n FROM w)
SELECT '' AS idx, 'statistic' AS col, round(sum(d0 - d * n0 / n) * sum(d0 - d * n0 / n) / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n0 / n * (1 - n0 / n) ELSE 0 END), 4) AS value FROM n""")
def logrank(spark, sf):
    return flat(survival.logrank(_spells(spark, sf), "dur", "event", "l_linestatus"), spark).where("col = 'statistic'")


@query()
def cox(spark, sf):
    return flat(_spells(spark, sf).cox("dur", "event", ["l_quantity", "l_linestatus"]), spark, 6)


@query()
def weibull(spark, sf):
    return flat(_spells(spark, sf).weibull_aft("dur", "event", ["l_quantity"]), spark, 6)


def _treated(spark, sf) -> PrivateFrame:
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_extendedprice", "l_quantity", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"))
    return PrivateFrame.bind(j, resolve_policy(suppression="light"))


@query()
def treatment_effect(spark, sf):
    rows = [flat(_treated(spark, sf).ate("l_extendedprice", "urgent", ["l_quantity"], m), spark, 2).withColumn("idx", F.lit(m)) for m in ("weighting", "stratification", "regression", "matching")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ---------------------------------------------------------------- event time

@query("""SELECT date_trunc('day', ts) AS start, event_type, CAST(CASE WHEN count(*) >= 5 THEN count(*) END AS DOUBLE) AS count FROM events GROUP BY ALL""")
def windowed(spark, sf):
    out = windowed_counts(load(spark, sf, "events"), "ts", ["event_type"], resolve_policy(suppression="light"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import catalogue_more  # noqa: E402, F401  adds its queries
