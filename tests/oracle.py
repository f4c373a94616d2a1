"""Compare a registered query with its oracle the way the driver does."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def compare(df, con, sql):
    """None if equal, else a description of the first difference."""
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows([c[0] for c in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {lack}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(diff)} rows differ, first {diff[0]}" if diff else None
