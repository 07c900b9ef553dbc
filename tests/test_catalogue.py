"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from hushframe.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in ORACLES:
        c = duckdb.connect()
        c.execute("set timezone='UTC'")
        for f in os.listdir(SF):
            c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
        found = c.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == cols
        want = sorted(tuple(text(r[names.index(k)]) for k in cols) for r in found.fetchall())
        assert got == want


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data operators, with and without the pipeline that uses them."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for keep_pipeline in (True, False):
        own = tmp_path / str(keep_pipeline)
        shutil.copytree(f"{here}/hushframe", own / "hushframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ("__spark_entry__.py", *["corpus_pipeline.py"] * keep_pipeline):
            if os.path.exists(f"{here}/{f}"):
                shutil.copy(f"{here}/{f}", own)
        code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=own, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert done.stdout.split() == sorted(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_outer_joins_take_whole_tables(spark, how):
    sf, kind = "/root/testdata/sf0.1", {"left": "LEFT", "right": "RIGHT", "outer": "FULL"}[how]
    want = duckdb.sql(f"""SELECT coalesce(lang, 'none') || '/' || coalesce(quality, 9) AS g, count(*) AS n
FROM '{sf}/documents.parquet' {kind} JOIN '{sf}/labels.parquet' USING (doc_id) GROUP BY 1 HAVING count(*) >= 5""").fetchall()
    got = {r.g: r.value for r in QUERIES[f"merge_{how}"](spark, sf).collect() if r.value is not None}
    assert got == dict(want)
