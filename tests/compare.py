"""Run a registered query and its SQL side by side and compare all values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        df[column] = df[column].map(as_text)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def as_text(value: object) -> str:
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return f"{type(value).__name__}:{value}"


def integer_columns(df: pd.DataFrame) -> pd.DataFrame:
    """Integers with nulls come back as floats on one side only; compare them as floats."""
    for column in df.columns:
        if pd.api.types.is_integer_dtype(df[column].dtype):
            df[column] = df[column].astype("float64")
    return df


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = normal(integer_columns(left)), normal(integer_columns(right))
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    where = a.index[bad][:3]
    return f"{int(bad.sum())} rows differ, e.g.\n{a.loc[where].to_dict('records')}\n{b.loc[where].to_dict('records')}"[:3000]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from sitewright.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(folder)
    jobs, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in jobs if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = []
    for name in wanted:
        begin = time.time()
        try:
            got = jobs[name](spark, folder).toPandas()
            took = time.time() - begin
            if name in sqls:
                begin = time.time()
                want = con.execute(sqls[name]).df()
                result = difference(got, want)
                sql_time = f"sql {time.time() - begin:.1f}s"
            else:
                result, sql_time = None, "no sql"
        except Exception as error:  # report and go on with the next query
            took, result, sql_time = time.time() - begin, f"{type(error).__name__}: {str(error)[:1500]}", ""
            got = pd.DataFrame()
        print(f"{'ok  ' if result is None else 'FAIL'} {name} rows={len(got)} {took:.1f}s {sql_time}", flush=True)
        if result:
            bad.append(name)
            print("     ", result, flush=True)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} agree; failed: {bad}")


if __name__ == "__main__":
    main()
