"""Runs a query and its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


def compare(spark, query, sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got = query(spark, sf_dir)
        found = c.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(found.fetchall(), columns)
