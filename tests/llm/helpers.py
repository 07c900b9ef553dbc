"""Running a query on a small fixture and its SQL in DuckDB on the same rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

DOC = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def write(folder, **tables):
    for name, t in tables.items():
        pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)


def docs(rows, **more):
    """documents from (doc_id, text); more: further columns."""
    t = pa.table({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array(["en"] * len(rows), pa.string()), "source": pa.array(["s"] * len(rows), pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
    })
    for k, v in more.items():
        t = t.append_column(k, pa.array(v))
    return t


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def sql_rows(folder, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    pick = [names.index(x) for x in sorted(names)]
    return sorted((tuple(r[k] for k in pick) for r in found.fetchall()), key=repr)
