"""Compare the registered queries with their SQL in DuckDB: python tests/compare.py <sf> [names]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in a fixed order, values as text."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "" if pd.isna(v) else repr(round(float(v), 6)))
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differs(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        # integer columns with nulls come as floats from one engine only
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"column {c}: {bad.sum()} differ, first {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return None


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import oracle_sql, queries
    from tracefold.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sql, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            t = time.time()
            got = fn(spark, sf_dir)
            types = dict(got.dtypes)
            got = got.toPandas()
            took = time.time() - t
            if name not in sql:
                print(f"{name:26s} rows-only {len(got):8d} {took:6.2f}s", flush=True)
                continue
            t = time.time()
            rel = con.sql(sql[name])
            kinds = dict(zip(rel.columns, map(str, rel.types)))
            why = differs(got, rel.df())
            print(f"{name:26s} {'ok' if why is None else 'DIFFERS ' + why} {len(got):8d} {took:6.2f}s sql {time.time() - t:.2f}s", flush=True)
            short = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
            odd = {c: (k, kinds.get(c)) for c, k in types.items() if c in kinds and short.get(k, kinds[c]) != kinds[c]}
            if odd:
                print("    types", odd)
            bad += why is not None
        except Exception as e:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"{name:26s} FAILED {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
