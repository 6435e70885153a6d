"""Spark result against DuckDB's on the same tables, as multisets of rows."""

import glob

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if glob.glob(path) and not glob.glob(path + '/*') else path + '/*.parquet'}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, got_names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    expected, names = rows([d[0] for d in cur.description], cur.fetchall())
    assert got_names == names
    assert len(got) == len(expected)
    assert got == expected
