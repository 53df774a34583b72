"""A query's rows against its DuckDB oracle's, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def spelt(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(float(v))
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(spelt(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def agree(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
