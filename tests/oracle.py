"""Comparison of a query with its SQL, on one data folder."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(map(plain, r)) for r in values.itertuples(index=False)), key=str)


def same(query, sql, spark, sf_dir):
    got, expected = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)
    return got
