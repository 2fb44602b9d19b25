"""Run a registered query and its oracle and compare names, row counts and values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def kind(v):
    return {int: "int", float: "float", bool: "bool", str: "str"}.get(type(v), type(v).__name__)


def compare(spark_df, con, sql):
    """Empty string if equal, else what differs."""
    names = sorted(spark_df.columns)
    rel = con.execute(sql)
    theirs_cols = [d[0] for d in rel.description]
    theirs_raw = rel.fetchall()
    if names != sorted(theirs_cols):
        return f"columns {names} != {sorted(theirs_cols)}"
    ours_raw = spark_df.select(*[f"`{n}`" for n in names]).collect()
    at = [theirs_cols.index(n) for n in names]
    ours = [tuple(canon(v) for v in r) for r in ours_raw]
    theirs = [tuple(canon(r[i]) for i in at) for r in theirs_raw]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for i, n in enumerate(names):
        a = {kind(r[i]) for r in ours if r[i] is not None}
        b = {kind(r[i]) for r in theirs if r[i] is not None}
        if a != b:
            return f"type of {n}: {a} != {b}"
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    ours.sort(key=key)
    theirs.sort(key=key)
    for a, b in zip(ours, theirs):
        if a != b:
            return f"values {names}: {str(a)[:300]} != {str(b)[:300]}"
    return "" if ours else "no rows on either side"
