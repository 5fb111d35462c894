"""Order-free comparison of a Spark result with DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con.sql(sql).df()


def rows_of(df):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
