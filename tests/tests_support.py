"""Helpers of the tests."""

import os
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(value):
    """A value as both engines tell it: arrays as tuples, floats to six digits, dates as text."""
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


def table(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle(sql, data):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = c.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr), sorted(rel.columns)
