"""Compare a query with its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v.item() if hasattr(v, "item") else v


def rows(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(map(_plain, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


def assert_same(spark_df, sql_df):
    assert sorted(spark_df.columns) == sorted(sql_df.columns)
    a, b = rows(spark_df), rows(sql_df)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])
