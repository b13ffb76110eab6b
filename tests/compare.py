"""Rows of a query and of its SQL twin, in one form."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v) + 0.0:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def of_sql(sql, tables):
    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        else:
            con.register(name, source)
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted(tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())


def of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
