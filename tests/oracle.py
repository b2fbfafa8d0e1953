"""A query's rows beside those of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def sorted_rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    left, right = sorted_rows(df.columns, [tuple(r) for r in df.collect()]), sorted_rows(names, got.fetchall())
    assert len(left) == len(right)
    assert left == right
