"""Run registered queries against their SQL oracles in DuckDB."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from canonframe.plans.views import TABLES


LAST = [0.0]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _frame(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].astype(object).map(lambda v: "NULL" if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA
                            else (repr(round(v, 9)) if isinstance(v, float) else str(v)))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def kinds(types) -> list[str]:
    out = []
    for t in types:
        t = str(t).upper()
        if t in ("BIGINT", "INT", "INTEGER", "SMALLINT", "TINYINT"):
            out.append("int" if t != "BIGINT" else "bigint")
        elif t in ("DOUBLE", "FLOAT"):
            out.append("double")
        else:
            out.append(t)
    return out


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    t0 = time.time()
    got = spark_df.toPandas()
    LAST[0] = time.time() - t0
    if not len(got):
        return "no rows: the query tests nothing"
    rel = con.sql(sql)
    want = rel.df()
    names = dict(zip(rel.columns, rel.types))
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    huge = [c for c, t in names.items() if "HUGEINT" in str(t) or "DECIMAL" in str(t)]
    if huge:
        return f"oracle type {huge}"
    spark_kinds = kinds([f.dataType.simpleString() for f in sorted(spark_df.schema, key=lambda f: f.name)])
    duck_kinds = kinds([names[c] for c in sorted(names)])
    for c, a, b in zip(sorted(names), spark_kinds, duck_kinds):
        a, b = a.replace("STRING", "VARCHAR"), b
        if a != b:
            return f"type of {c}: {a} != {b}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    # Integer columns with NULLs arrive as float on one side only: compare them as Int64.
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].dtype.kind == "f" and str(names[c]) in ("BIGINT", "INTEGER"):
                frame[c] = pd.Series([None if v != v else int(v) for v in frame[c]], dtype=object)
    a, b = _frame(got), _frame(want)
    if not a.equals(b):
        diff = (a != b).any(axis=1)
        i = diff.idxmax()
        return f"values differ in {int(diff.sum())} rows; first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    import pathlib
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from canonframe.session import build_session

    sf = sys.argv[1]
    want = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g", "spark.driver.maxResultSize": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"/root/testdata/sf{sf}")
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            note = ""
            df = fn(spark, f"/root/testdata/sf{sf}")
            if name in sqls:
                err = compare(df, con, sqls[name])
                note = f"spark {LAST[0]:.1f}s"
            else:
                err, note = None, f"rows-only {df.count()}"
        except Exception as exc:  # report and go on with the next query
            err, note = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += bool(err)
        print(f"{'FAIL' if err else 'ok  '} {name} {time.time()-t0:.1f}s {note} {err or ''}", flush=True)
    print("failures:", bad)
