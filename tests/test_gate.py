"""The executable threat model: what the gate and the mediator refuse, and what passes."""

import pandas
import pytest

from hushframe import run
from hushframe.gate import validate

NAMES = frozenset({"df", "safe", "pd", "np", "smf"})

REFUSED = [
    # rows and single values
    "df.head()", "df.tail(3)", "df.sample(5)", "df.iloc[0]", "df.loc[0]", "df.at", "df.values", "df['a'].tolist()",
    "df.to_csv('x')", "df.to_dict()", "df['a'].item()", "df.iterrows()", "df[0]", "df[True]", "df[1:5]", "df['a'].idxmax()",
    "df['a'].nlargest(3)", "df['a'].rank()", "df.info()", "df['a'].mode()", "df.first()",
    # code
    "df.apply(lambda r: r)", "df.pipe(print)", "eval('1')", "exec('1')", "open('/etc/passwd')", "__import__('os')", "getattr(df, '_df')",
    "df._df", "df.__class__", "().__class__.__bases__", "lambda: 1", "[x for x in df]", "f'{df}'", "'{0._df}'.format(df)", "(x := 1)",
    "import os", "from os import path", "import numpy.os as _n", "from numpy import *", "df.query('a > 1')", "df.eval('a')", "type(df)",
    # structure
    "for x in df:\n    x", "def f():\n    pass", "df.a = 1", "df['a'] = 1", "a, b = 1, 2", "_x = 1", "if 1:\n    df", "del df", "a += 1", "",
    "while True:\n    1", "with df:\n    1", "try:\n    1\nexcept:\n    2", "class A:\n    pass", "assert df", "global df",
    # the engine's doors
    "df.collect()", "df.rdd", "df.toPandas()", "df.show()", "df.write", "df.sparkSession", "df.mapInPandas(1)", "df.explain()", "df.selectExpr('a')",
    "print(df)", "df()(1)", "(df.mean)()()",
]


@pytest.mark.parametrize("code", REFUSED)
def test_refused(code):
    assert not validate(code, names=NAMES).ok


@pytest.mark.parametrize("code", [
    "df['a'].mean()", "x = df[df.a > 1]\nx.groupby('g')['a'].mean()", "import numpy as np\nnp.log(df['a'])", "from lifelines import CoxPHFitter\nCoxPHFitter()",
    "df.assign(x=df.a + 1)", "round(1.5)", "df['a'].max()",
])
def test_accepted(code):
    assert validate(code, names=NAMES).ok


def test_gate_names_code_only():
    r = validate("df.head()", names=NAMES)
    assert r.error.token == "head" and r.error.line == 1 and r.error.kind == "attribute"


@pytest.fixture(scope="module")
def df(spark):
    rows = pandas.DataFrame({
        "g": ["a", "b"] * 50 + ["z"] * 3, "salary": [float(1000 + 10 * i) for i in range(103)],
        "name": [f"person {i}" for i in range(103)], "yes": [i % 2 for i in range(103)],
    })
    return spark.createDataFrame(rows)


@pytest.mark.parametrize("code", ["df", "df['salary']", "df.groupby('g')", "df.groupby('g')['salary']", "smf.ols('salary ~ yes', data=df)", "smf.ols('salary ~ yes', data=df).fit()", "None", "'text'", "5", "df.salary > 3"])
def test_mediator_refuses_what_is_private(df, code):
    r = run(code, {"df": df}, suppression="light", catalog=False)
    assert not r.ok and r.error["kind"] in ("disclosure", "runtime")


def test_messages_hold_no_data(df):
    for code in ["df['name'].astype('float').nothing()", "df['person 1']", "df.groupby('nope').size()", "pd.to_numeric(df['name'])", "df['name'].mean()"]:
        r = run(code, {"df": df}, suppression="light", catalog=False)
        assert not r.ok and "person 5" not in str(r.error)


@pytest.mark.parametrize("code", ["len(df)", "bool(df['salary'])", "df.groupby('g')['salary'].agg(len)", "df['g'].map(str)", "df.assign(x=[1, 2])", "df['salary'].replace(abs, 1)", "df.merge(5, on='g')", "df.nothing", "safe.nothing", "pd.read_csv('x')", "np.random", "smf.mixedlm"])
def test_refused_while_running(df, code):
    assert not run(code, {"df": df}, suppression="light", catalog=False).ok


def test_small_groups_are_blank(df):
    p = run("df.groupby('g')['salary'].mean()", {"df": df}, suppression="light").payload
    assert p["index"] == ["a", "b", "z"] and p["values"][2] is None and p["values"][0] is not None


def test_callers_can_only_tighten(df):
    tight = run("df.groupby('g')['salary'].mean(min_n=60)", {"df": df}, suppression="light", catalog=False).payload
    loose = run("df.groupby('g')['salary'].mean(min_n=1, round=1)", {"df": df}, suppression="standard", catalog=False).payload
    assert tight["values"] == [None] * 3
    assert loose["values"][2] is None and loose["values"][0] % 10 == 0


def test_extremes_need_support(df):
    assert run("df['salary'].max()", {"df": df}, suppression="light", catalog=False).payload["value"] is None
    assert run("df['yes'].max()", {"df": df}, suppression="light", catalog=False).payload["value"] == 1


def test_several_results_and_catalog(df):
    r = run("a = df[df.yes == 1]\na['salary'].mean()\ndf\ndf.value_counts('g')", {"df": df}, suppression="light")
    assert r.ok and r.kind == "series" and len(r.results) == 2
    names = {c["name"]: c for c in r.catalog}
    assert names["df"]["n_rows"] == 103 and names["a"]["n_columns"] == 4
    assert "person" not in str(r.as_dict())
    assert run("a = df[['g']]", {"df": df}, suppression="light").kind == "none"
    assert not run("df['salary'].mean()\ndf", {"df": df}, suppression="light").ok
