"""Private algebra, measures and models, against pandas and closed forms."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from hushframe import PRESETS, Suppression, resolve_policy, run
from hushframe.errors import DisclosureError
from hushframe.functions import exprs
from hushframe.operators import release as R
from hushframe.operators.frame import PrivateFrame
from hushframe.operators.models import dist, hypothesis, regression, survival
from hushframe.operators.models.design import parse
from hushframe.operators import verbs  # noqa: F401


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 300
    out = pd.DataFrame({
        "pos": range(n), "unit": rng.choice(list("abc"), n), "sex": rng.choice(["f", "m"], n),
        "salary": rng.normal(500, 80, n).round(2), "age": rng.integers(20, 70, n),
        "text": rng.choice(["Apple pie", "o'neil a-b", "  pad ", "x"], n),
        "start": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, n), "D"),
    })
    out["end"] = out["start"] + pd.to_timedelta(rng.integers(0, 90, n), "D")
    out.loc[rng.choice(n, 15, replace=False), "salary"] = np.nan
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return PrivateFrame.bind(spark.createDataFrame(data), resolve_policy(suppression="light"), ["pos"]).sort_values("pos")


def rows(frame, column):
    """The private values, read behind the facade: tests only."""
    own = frame.sort_values("pos")
    aligned = own._align(column)
    return [r[0] for r in own._df.select("pos", aligned.alias("value")).orderBy("pos").select("value").collect()]


def same(got, want):
    for a, b in zip(got, list(want)):
        if b is None or (isinstance(b, float) and math.isnan(b)) or b is pd.NaT:
            assert a is None
        elif isinstance(b, (float, np.floating)):
            assert a == pytest.approx(float(b), rel=1e-9, abs=1e-9)
        else:
            assert a == b


@pytest.mark.parametrize("f", [
    lambda c: c.shift(2), lambda c: c.shift(-1), lambda c: c.diff(), lambda c: c.cumsum(), lambda c: c.cumprod(), lambda c: c.cummax(), lambda c: c.cummin(),
    lambda c: c.ffill(), lambda c: c.bfill(), lambda c: c.interpolate(), lambda c: c.shift(1).diff(), lambda c: c % 7, lambda c: -c % 7, lambda c: c / 3, lambda c: c ** 2,
    lambda c: c.clip(450, 550), lambda c: c.round(0), lambda c: c.abs(), lambda c: c.fillna(0.0), lambda c: c.where(c > 500), lambda c: c.mask(c > 500, 1.0), lambda c: 1000 - c,
])
def test_columns_as_in_pandas(frame, data, f):
    same(rows(frame, f(frame["salary"])), f(data["salary"]))


def test_pct_change_fills_first(frame, data):
    same(rows(frame, frame["salary"].pct_change()), data["salary"].ffill().pct_change())


@pytest.mark.parametrize("f", [
    lambda s: s.str.upper(), lambda s: s.str.title(), lambda s: s.str.capitalize(), lambda s: s.str.strip(), lambda s: s.str.lstrip(), lambda s: s.str.len(),
    lambda s: s.str.pad(12, side="both", fillchar="*"), lambda s: s.str.pad(5, side="right", fillchar="."), lambda s: s.str.zfill(7), lambda s: s.str.slice(1, -1), lambda s: s.str.slice(-3), lambda s: s.str.slice(0, 6, 2), lambda s: s.str.slice(None, None, -1),
    lambda s: s.str.replace("p", "q", regex=False), lambda s: s.str.contains("pie", regex=False), lambda s: s.str.startswith("o"), lambda s: s.str.endswith("x"), lambda s: s.str.find("p"), lambda s: s.isin(["x"]),
])
def test_text_as_in_pandas(frame, data, f):
    same(rows(frame, f(frame["text"])), f(data["text"]))


@pytest.mark.parametrize("part", ["year", "month", "day", "quarter", "dayofweek", "dayofyear", "days_in_month", "is_month_start", "is_month_end", "hour"])
def test_dates_as_in_pandas(frame, data, part):
    same(rows(frame, getattr(frame["start"].dt, part)), [x.item() if hasattr(x, "item") else x for x in getattr(data["start"].dt, part)])


def test_date_difference(frame, data):
    same(rows(frame, (frame["end"] - frame["start"]).dt.days), (data["end"] - data["start"]).dt.days.tolist())
    same(rows(frame, (frame["start"] - frame["end"]).dt.days), (data["start"] - data["end"]).dt.days.tolist())


def test_column_of_another_frame_is_aligned(frame, data):
    other = frame.sort_values("salary")
    joined = frame.assign(d=other["salary"].diff())
    want = data.assign(d=data.sort_values(["salary", "pos"])["salary"].diff())["d"]
    assert joined["d"].mean().payload["value"] == pytest.approx(want.mean())
    mask = frame[frame.age > 40]
    assert mask[frame.sex == "f"]["salary"].count().payload["value"] == data[(data.age > 40) & (data.sex == "f")].salary.count()


def test_window_is_taken_before_the_filter(frame, data):
    got = frame[frame["salary"].cumsum() > 5000]["salary"].count().payload["value"]
    assert got == data[data.salary.cumsum() > 5000].salary.count()


def test_expression_refusals():
    from pyspark.sql import functions as F

    for text in ["a.b", "open('x')", "a if a else a", "[a]", "a.__class__", "where(a)", "lambda: a", "b", "a < a < a", "log(a, base=2)"]:
        with pytest.raises(DisclosureError):
            exprs.compile_expr(text, {"a": F.lit(1)})


def test_reshapes(frame, data):
    long = frame.melt(["unit"], ["salary", "age"])
    got = long.groupby("variable")["value"].mean().payload
    assert got["index"] == ["age", "salary"] and got["values"][1] == pytest.approx(data.salary.mean())
    wide = frame.summarise(["unit", "sex"], m=("salary", "mean")).pivot("unit", "sex", "m")
    assert wide._cols == ["unit", "f", "m"]
    with pytest.raises(DisclosureError):
        frame.pivot("unit", "sex", "salary")
    assert frame.explode("age") is frame


def test_null_keys_meet(spark):
    a = PrivateFrame.bind(spark.createDataFrame([(None, 1), (1, 2)], "k int, a int"), resolve_policy(suppression="off"))
    b = PrivateFrame.bind(spark.createDataFrame([(None, 3), (2, 4)], "k int, a int"), resolve_policy(suppression="off"))
    assert a.merge(b, on="k", how="outer")._df.select("k", "a", "a_y").where("k is null").count() == 1
    assert a.merge(b, on="k", how="outer")["a_y"].count().payload["value"] == 2


# ---------------------------------------------------------------- measures

@pytest.fixture(scope="module")
def tiers(spark):
    rng = np.random.default_rng(3)
    out = pd.DataFrame({"grp": ["common"] * 394 + ["rare"] * 6, "sex": rng.choice(["f", "m"], 400), "income": rng.normal(400_000, 50_000, 400).round(), "uid": range(400)})
    out.loc[:2, "income"] = [5e6, 6e6, 7e6]
    return out, spark.createDataFrame(out)


def test_tiers(tiers):
    data, df = tiers
    light = run("df.groupby('grp')['income'].mean()", {"df": df}, suppression="light", catalog=False).payload["values"]
    strict = run("df.groupby('grp')['income'].mean()", {"df": df}, suppression="standard", catalog=False).payload["values"]
    assert light[1] is not None and strict[1] is None  # 6 rows: over min_n, under the descriptive floor
    assert strict[0] < light[0] and strict[0] % 10 == 0  # outliers are winsorised
    assert run("df.value_counts('uid')", {"df": df}, suppression="standard", catalog=False).error["kind"] == "disclosure"
    assert run("df.value_counts('uid')", {"df": df}, suppression="light", catalog=False).ok
    assert run("df['income'].mean()", {"df": df}, suppression="microdata", catalog=False).payload["value"] is None


def test_edit_floor(tiers):
    _, df = tiers
    edit = "df.assign(x=df['income'].where(df.uid > {}, 0))['x'].mean()"
    assert not run(edit.format(3), {"df": df}, suppression="standard", catalog=False).ok
    assert run(edit.format(200), {"df": df}, suppression="standard", catalog=False).ok
    assert not run(edit.format(395), {"df": df}, suppression="standard", catalog=False).ok


def test_noise(tiers, monkeypatch):
    _, df = tiers
    s = Suppression(min_n=5, count_noise=2)
    code = "df.value_counts('sex')"
    monkeypatch.delenv(R.SALT, raising=False)
    assert not run(code, {"df": df}, suppression=s, catalog=False).ok
    monkeypatch.setenv(R.SALT, "one")
    first, again = (run(code, {"df": df}, suppression=s, catalog=False).payload for _ in range(2))
    plain = run(code, {"df": df}, suppression="light", catalog=False).payload
    assert first == again
    assert all(abs(a - b) <= 2 for a, b in zip(sorted(first["values"]), sorted(plain["values"])))
    means = [run("df.groupby('sex')['income'].mean()", {"df": df}, suppression=x, catalog=False).payload for x in (s, "light")]
    assert means[0]["values"] == means[1]["values"]


def test_presets_and_policy():
    assert resolve_policy(["public", "sensitive"]).suppression == PRESETS["microdata"]
    assert resolve_policy("public").min_n == 1
    with pytest.raises(ValueError):
        resolve_policy(suppression="nothing")


def test_nice_edges_hide_the_ends():
    edges = R.nice_edges(3.7, 98.2, 10)
    assert edges[0] <= 3.7 and edges[-1] >= 98.2 and all(e % 10 == 0 for e in edges)


# ---------------------------------------------------------------- models

def test_tails():
    assert dist.t_sf2(2.0, 10) == pytest.approx(0.0733880347707404)
    assert dist.f_sf(3.0, 2, 20) == pytest.approx((1 + 2 * 3.0 / 20) ** -10)  # closed form for two degrees
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.normal_sf2(1.959963984540054) == pytest.approx(0.05)
    assert dist.t_crit(10) == pytest.approx(2.2281388519649385)


def test_formulas():
    f = parse("y ~ a*b + C(c) - 1")
    assert f.terms == [("a",), ("b",), ("a", "b"), ("C(c)",)] and not f.intercept
    p = parse("y ~ x | f1 + f2^f3 | e ~ z", panel=True)
    assert p.fe == [("f1",), ("f2", "f3")] and p.endog == ["e"] and p.instruments == ["z"]
    for bad in ["y", "y ~ x ~ z", "y ~ __import__('os')", "y ~ x | f", "np.log(y) ~ x", "y ~ x.b", "y ~ a*b*c"]:
        with pytest.raises(DisclosureError):
            parse(bad)


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    n = 800
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.5 * x1))).astype(int)
    firm, year = rng.integers(0, 25, n), rng.integers(0, 6, n)
    fe = rng.normal(size=25)[firm] + rng.normal(size=6)[year]
    z = rng.normal(size=n)
    endog = z + 0.5 * x2 + rng.normal(size=n)
    out = pd.DataFrame({
        "x1": x1, "x2": x2, "t": t, "y": 2.0 * t + x1 + 0.5 * x2 + rng.normal(size=n), "firm": [f"f{i}" for i in firm], "year": [str(i) for i in year],
        "fy": 1.5 * x1 + fe + 0.1 * rng.normal(size=n), "z": z, "endog": endog, "iy": 3 * endog - 2 * x2 + rng.normal(size=n),
        "dur": np.ceil(rng.exponential(10 * np.exp(-0.5 * x1))), "died": (rng.random(n) < 0.7).astype(int), "count": rng.poisson(np.exp(0.3 + 0.4 * x1)),
    })
    return out, PrivateFrame.bind(spark.createDataFrame(out), resolve_policy(suppression="light"))


def coef(released, name):
    p = released.payload
    return dict(zip(p["columns"], p["data"][p["index"].index(name)]))


def test_ols_is_the_normal_equations(model):
    data, f = model
    x = np.column_stack([np.ones(len(data)), data.x1, data.x2])
    beta, rss, *_ = np.linalg.lstsq(x, data.y.to_numpy(), rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(data) - 3))
    got = coef(f.ols("y", ["x1", "x2"]), "x1")
    assert got["coef"] == pytest.approx(beta[1]) and got["std_err"] == pytest.approx(se[1])


def test_glm_scores_vanish(model):
    data, f = model
    fit = regression.by_names(f, "t", ["x1", "x2"], "logit")
    mu = 1 / (1 + np.exp(-(fit._beta[0] + fit._beta[1] * data.x1 + fit._beta[2] * data.x2)))
    assert np.abs([(data.t - mu).sum(), ((data.t - mu) * data.x1).sum()]).max() < 1e-6
    assert fit.margeff().payload["data"][0][0] == pytest.approx(float((mu * (1 - mu)).mean() * fit._beta[1]))
    poisson = coef(f.poisson("count", ["x1"]), "x1")
    assert poisson["coef"] == pytest.approx(0.4, abs=0.1)
    assert fit.resid.mean().payload["value"] == pytest.approx(0, abs=1e-9)


def test_fixed_effects_are_dummies(model):
    data, f = model
    d = pd.get_dummies(data[["firm", "year"]], drop_first=True).to_numpy(float)
    x = np.column_stack([data.x1, np.ones(len(data)), d])
    beta = np.linalg.lstsq(x, data.fy.to_numpy(), rcond=None)[0]
    got = coef(f.feols("fy", ["x1"], ["firm", "year"], "firm"), "x1")
    assert got["coef"] == pytest.approx(beta[0], abs=1e-7)
    assert coef(f.iv("iy", ["x2"], "endog", ["z"]), "endog")["coef"] == pytest.approx(3, abs=0.2)


def test_effects_are_recovered(model):
    _, f = model
    for method in ("weighting", "matching", "stratification", "regression"):
        got = f.ate("y", "t", ["x1", "x2"], method).payload
        assert got["effect"] == pytest.approx(2.0, abs=0.45), method
    assert abs(f.refute_ate("y", "t", ["x1", "x2"], refuter="placebo").payload["effect"]) < 0.4
    assert f.refute_ate("y", "t", ["x1", "x2"], refuter="random_common_cause").payload["effect"] == pytest.approx(2.0, abs=0.45)


def test_survival(model):
    data, f = model
    c = coef(f.cox("dur", "died", ["x1"]), "x1")
    assert 0.2 < c["coef"] < 0.8
    assert coef(f.weibull_aft("dur", "died", ["x1"]), "mu:x1")["coef"] < -0.2
    for verb in (f.lognormal_aft, f.loglogistic_aft):
        assert coef(verb("dur", "died", ["x1"]), "mu:x1")["coef"] < -0.2
    curve = survival.released_curve(f, "dur", "died").orderBy("t").collect()
    s, want = 1.0, {}
    for t in sorted(data.dur.unique()):
        s *= 1 - data[(data.dur == t)].died.sum() / (data.dur >= t).sum()
        want[t] = s
    assert all(r.survival == pytest.approx(want[r.t]) for r in curve)


def test_hypothesis_tests(model):
    data, f = model
    a, b = data[data.t == 1].y, data[data.t == 0].y
    got = hypothesis.ttest(f, "y", "t").payload
    assert got["statistic"] == pytest.approx((b.mean() - a.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    ranks = data.y.rank()
    assert hypothesis.mannwhitney(f, "y", "t").payload["statistic"] == pytest.approx(ranks[data.t == 0].sum() - (data.t == 0).sum() * ((data.t == 0).sum() + 1) / 2)
    assert hypothesis.corr_test(f, "x1", "y", "spearman").payload["statistic"] == pytest.approx(data.x1.rank().corr(data.y.rank()))
    assert hypothesis.chisq(f, "t", "died").payload["df"] == 1


def test_synthetic_control(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2, 20)).cumsum(axis=1)
    rows = []
    for u in range(11):
        w = rng.random()
        series = w * base[0] + (1 - w) * base[1] + 10
        if u == 0:
            series = 0.5 * base[0] + 0.5 * base[1] + 10 + 3 * (np.arange(20) >= 15)
        rows += [(f"u{u}", t, float(series[t]), 50) for t in range(20)]
    f = PrivateFrame.bind(spark.createDataFrame(rows, "unit string, time int, y double, size int"), resolve_policy(suppression="light"))
    got = f.synthetic_control("unit", "time", "y", "u0", 15, unit_size="size").payload
    assert got["att"] == pytest.approx(3, abs=0.5) and "weights" not in got


def test_anova_takes_all_groups(spark):
    df = spark.range(24_000).selectExpr("id % 12000 as g", "cast(id % 12000 + 7 * floor(id / 12000) as double) as v")
    f = PrivateFrame.bind(df, resolve_policy(suppression="off"))
    data = df.toPandas()
    means = data.groupby("g").v.transform("mean")
    want = ((means - data.v.mean()) ** 2).sum() / 11_999 / (((data.v - means) ** 2).sum() / 12_000)
    got = hypothesis.anova(f, "v", "g").payload
    assert got["df_between"] == 11_999 and got["statistic"] == pytest.approx(want, rel=1e-6)
    small = PrivateFrame.bind(df.union(spark.sql("select 99999L, 1d")), resolve_policy(suppression="light"))
    with pytest.raises(DisclosureError):
        hypothesis.anova(small, "v", "g")


def test_synthetic_control_takes_all_cells(spark):
    """More cells than a fixed number of them, of which none may be lost."""
    df = spark.range(210_000).selectExpr("concat('u', id % 300) as unit", "cast(floor(id / 300) as int) as time", "50 as size").selectExpr(
        "*", "sin(time) * (1 + cast(substr(unit, 2) as int) % 7) + if(unit = 'u0' and time >= 690, 3, 0) as y"
    )
    f = PrivateFrame.bind(df.where("unit <> 'u5' or time <> 3"), resolve_policy(suppression="light"))
    got = f.synthetic_control("unit", "time", "y", "u0", 690, unit_size="size").payload
    assert got["att"] == pytest.approx(3, abs=0.1) and len(got["times"]) == len(got["gap"]) == 700


def test_charts(tiers):
    _, df = tiers
    src = {"df": df}
    assert run("df.value_counts('sex').plot.bar()", src, suppression="light", catalog=False).payload["kind"] == "bar"
    assert "#" in run("df['income'].plot.hist()", src, suppression="light", render="ascii", catalog=False).payload["data"]
    assert "<svg" in run("df.value_counts('sex').plot.pie()", src, suppression="light", render="html", catalog=False).payload["data"]
    assert run("df.value_counts('sex').plot.barh()", src, suppression="light", render="plotly", catalog=False).payload["data"]["data"]
    assert not run("df.value_counts('sex').plot.scatter()", src, suppression="light", catalog=False).ok
    assert not run("df['income'].plot.scatter()", src, suppression="light", catalog=False).ok
    assert run("df['income'].plot.box()", src, suppression="light", catalog=False).payload["y"][0] is None


def test_streamed_cells_are_released_once(spark, tmp_path):
    import datetime

    from hushframe.streaming import windowed_counts

    day = lambda d: datetime.datetime(2024, 1, d, 12)
    rows = [(day(1), "a")] * 7 + [(day(1), "b")] * 2 + [(day(9), "a")]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", ["kind"], resolve_policy(suppression="light")).writeStream.format("memory").queryName("cells").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r["count"]) for r in spark.table("cells").collect()) == [("a", 7.0), ("b", None)]


# ---------------------------------------------------------------- what stands behind a cell

def test_support_survives_joins_and_reshapes(spark):
    """One person's income must not come out of a frame of groups by multiplying its rows."""
    rows = [(i % 40, float(1000 + i % 40), "x" if i % 2 else "y", [1.0, 2.0]) for i in range(400)] + [(99, 123456.0, "x", [1.0] * 9)]
    df = spark.createDataFrame(rows, "uid long, inc double, grp string, many array<double>")
    other = spark.createDataFrame([(99, k) for k in range(10)] + [(5, k) for k in range(10)], "uid long, k long")
    attacks = [
        "s.merge(o, on='uid').groupby('uid')['m'].mean()",
        "s.merge(o, on='uid')[['uid', 'm', 'k']].merge(o, on='uid').groupby('uid')['m'].mean()",
        "o.merge(s, on='uid', how='left').groupby('uid')['m'].median()",
        "s.merge(o, on='uid', how='outer').groupby('uid')['m'].sum()",
        "s.melt(['uid'], ['m', 'm2']).merge(o, on='uid').groupby('uid')['value'].mean()",
        "df.summarise(['uid', 'grp'], m=('inc', 'mean')).pivot('uid', 'grp', 'm').merge(o, on='uid').groupby('uid')['x'].mean()",
        "s.assign(t=s.m * 1.0).merge(o, on='uid').groupby('uid')['t'].mean()",
    ]
    for text in attacks:
        script = f"s = df.summarise('uid', m=('inc', 'mean'), m2=('inc', 'sum'))\n{text}"
        out = run(script, {"df": df, "o": other}, suppression="light")
        assert out.ok, (text, out.error)
        got = dict(zip(out.payload["index"], out.payload["values"]))
        assert got.get("99") is None, text
        assert "5" not in got or got["5"] is not None, text  # ten rows stand behind this one
    refused = run("s = df.summarise('uid', m=('inc', 'mean'))\nsmf.ols('m ~ uid', data=s).fit().summary()", {"df": df}, suppression="light")
    assert not refused.ok and "123456" not in str(refused.as_dict())
    again = run("s = df.summarise('uid', m=('inc', 'mean'))\nt = df[df.uid < 99].summarise('uid', n=('inc', 'count'))\nt.assign(m=s.m).merge(o, on='uid').groupby('uid')['m'].mean()", {"df": df, "o": other}, suppression="light")
    assert again.ok and "123456" not in str(again.as_dict())


def test_noise_key_of_the_policy(spark, monkeypatch):
    monkeypatch.delenv(R.SALT, raising=False)
    df = spark.createDataFrame([("a",)] * 2000, "g string")
    one, two = (PrivateFrame.bind(df, resolve_policy(suppression=replace(PRESETS["microdata"], noise_key=k))).value_counts("g").payload["values"][0] for k in ("k1", "k1"))
    assert one == two and abs(one - 2000) <= 2 and "k1" not in repr(replace(PRESETS["microdata"], noise_key="k1"))
    with pytest.raises(DisclosureError):
        PrivateFrame.bind(df, resolve_policy(suppression="microdata")).value_counts("g").payload


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(i, float(i) if i % 7 else float("nan"), "ab"[i % 2]) for i in range(100)] + [(None, None, None)]
    spark.createDataFrame(rows, "n long, x double, g string").write.parquet(str(tmp_path / "t"))
    f = PrivateFrame.bind(spark.read.parquet(str(tmp_path / "t")), resolve_policy(suppression="off"))
    for frame, want in ((f[f.x > 50], "GreaterThan(x,50"), (f[(f.n <= 9) & (f.g == "a")], "LessThanOrEqual(n,9"), (f.where("x", "<", 3.5), "LessThan(x,3.5"), (f[f.n.isin([3, 4])], "In(n"), (f[f.x.between(2, 9)], "GreaterThanOrEqual(x,2")):
        plan = frame._df.groupBy("g").count()._jdf.queryExecution().executedPlan().toString()
        assert want in plan[plan.index("PushedFilters") :], plan
    have = [r for r in rows if r[1] is not None and r[1] == r[1]]
    assert f[f.x > 50]["n"].count().payload["value"] == sum(r[1] > 50 for r in have)
    g = f.assign(x=f.x - 100)
    assert g[g.x < -50]["n"].count().payload["value"] == sum(r[1] - 100 < -50 for r in have)
    h = f.rename({"x": "n2", "n": "x"})
    assert h[h.x > 50]["n2"].count().payload["value"] == sum(r[0] > 50 for r in have)
    assert f[~(f.x > 50)]["n"].count().payload["value"] == sum(not (r[1] is not None and r[1] > 50) for r in rows if r[0] is not None)
    assert f[f.x != 1]["n"].count().payload["value"] == sum(r[1] != 1 for r in rows if r[0] is not None)


def test_row_ids_hold_still(spark):
    base = spark.range(2000).selectExpr("id", "id % 50 as k")
    shuffled = base.join(base.groupBy("k").count(), "k")
    f = PrivateFrame.bind(shuffled, resolve_policy(suppression="off"))
    sort = f.sort_values("id")
    joined = f.assign(p=sort["id"].shift(1))
    assert joined[joined.p == joined.id - 1]["id"].count().payload["value"] == 1999
    with pytest.raises(ValueError):
        PrivateFrame.bind(base, resolve_policy(suppression="off"), ["k"])


def test_group_transform_joins_the_groups(frame, data):
    for stat in ("mean", "sum", "median", "count", "size", "std"):
        got = frame.assign(t=frame.groupby("sex")["salary"].transform(stat))["t"].mean().payload["value"]
        assert got == pytest.approx(data.groupby("sex")["salary"].transform(stat).mean())


def test_an_interrupt_passes(spark):
    from hushframe import session

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        session._told("script", stop)
    assert session._told("script", lambda: 1 / 0)[1].args[0].endswith("ZeroDivisionError")


def test_repeated_rows_count_once(spark):
    """A join or reshape that repeats one person's row does not make enough rows of it."""
    rows = [(i, float(1000 + i), "x" if i % 2 else "y", [1.0] * 9) for i in range(60)] + [(99, 123456.0, "z", [123456.0] * 9)]
    df = spark.createDataFrame(rows, "uid long, inc double, grp string, many array<double>")
    other = spark.createDataFrame([(99, k) for k in range(12)] + [(i, 0) for i in range(60)], "uid long, k long")
    attacks = [
        "df.merge(o, on='uid').groupby('grp')['inc'].mean()", "o.merge(df, on='uid').groupby('grp')['inc'].sum()", "df.merge(o, on='uid').groupby('grp')['inc'].median()",
        "df.merge(o, on='uid').assign(t=df.merge(o, on='uid').inc).groupby('grp')['inc'].mean()", "df.merge(o, on='uid').merge(o, on='uid').groupby('grp')['inc'].describe()",
        "df.explode('many').groupby('grp')['many'].mean()", "df.explode('many').groupby('grp')['inc'].mean()", "df.merge(o, on='uid')['inc'].max()",
        "m = df.merge(o, on='uid')\nm.assign(z=m.inc * 2).groupby('grp')['z'].mean()", "m = df.merge(o, on='uid')\nm[m.inc > 100000]['inc'].mean()",
        "df.merge(o, on='uid').summarise('grp', v=('inc', 'mean')).merge(o.rename({'k': 'q'}).assign(grp='z'), on='grp').groupby('grp')['v'].mean()",
        "df.merge(o, on='uid').melt(['grp'], ['inc', 'k']).groupby(['grp', 'variable'])['value'].mean()",
    ]
    for text in attacks:
        for level in ("light", "microdata"):
            if level == "microdata" and "describe" not in text and "sum" not in text:
                continue
            noise = replace(PRESETS[level], noise_key="k") if level == "microdata" else level
            out = run(text, {"df": df, "o": other}, suppression=noise)
            assert "123456" not in str(out.as_dict()) and "246912" not in str(out.as_dict()), text
            if level == "light":
                assert out.ok, (text, out.error)
    counts = run("df.merge(o, on='uid').value_counts('grp')", {"df": df, "o": other}, suppression="light").payload
    assert dict(zip(counts["index"], counts["values"])) == {"x": 30, "y": 30, "z": None}
    fine = run("df.merge(o, on='uid').groupby('grp')['inc'].mean()", {"df": df, "o": other}, suppression="light").payload
    assert dict(zip(fine["index"], fine["values"])) == {"x": pytest.approx(1030), "y": pytest.approx(1029), "z": None}
