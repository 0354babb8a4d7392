"""Run a registered query and its SQL twin on the same tables and compare all rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def rows(df: pd.DataFrame) -> list[tuple]:
    norm = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(norm(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def same(spark_df, sql: str, folder: str) -> None:
    got, want = spark_df.toPandas(), run_sql(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want), (len(got), len(want))
    assert rows(got) == rows(want)
