"""A registered query against its SQL in DuckDB, as sorted rows with columns in order of name."""

import math

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations events lineitem orders customer part supplier nation region".split()
SF = "/root/testdata/sf0.001"


def same(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    want_rel = con.execute(sql)
    names = [d[0] for d in want_rel.description]
    assert sorted(names) == cols, (names, cols)
    want = [tuple(r[names.index(c)] for c in cols) for r in want_rel.fetchall()]
    key = lambda r: tuple(str(round(x, 4)) if isinstance(x, float) else str(x) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, float(y), rel_tol=1e-9, abs_tol=1e-9)), (a, b)
