"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, tuples):
    names = sorted(columns)
    places = [columns.index(n) for n in names]

    def plain(v):
        return float(v) if isinstance(v, float) else v

    return names, sorted(repr(tuple(plain(r[p]) for p in places)) for r in tuples)


def same(spark_frame, con, sql):
    found = con.execute(sql)
    theirs = rows([c[0] for c in found.description], found.fetchall())
    ours = rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
