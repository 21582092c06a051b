"""Compares a query with its SQL over the tables of a folder."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def differences(spark, entry, name, folder):
    """Rows, columns and types of the query that the SQL doesn't have, and the other way round."""
    got = entry.queries()[name](spark, folder)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    sql = entry.oracle_sql()[name]
    kinds = {n: str(k) for n, k, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    res = con.execute(sql)
    at = [d[0] for d in res.description]
    want = sorted(repr(tuple(r[at.index(c)] for c in names)) for r in res.fetchall()) if sorted(at) == names else at
    out = [] if rows == want else [x for x in zip(rows, want) if x[0] != x[1]][:3] + [(len(rows), len(want))]
    return out + [(c, k) for c, k in got.dtypes if KINDS.get(k) != kinds.get(c)]
