"""Compare a query with its SQL twin, whatever the order of rows and columns."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> str:
    if x is None or x is pd.NA or (isinstance(x, float) and x != x) or x is pd.NaT:
        return "null"
    if isinstance(x, float) or type(x).__name__ in ("Decimal", "float64", "float32"):
        return f"{float(x):.9g}"
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def same(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
