"""Runs queries beside their SQL."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def mismatches(spark, queries, sql):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    bad = []
    for name, text in sql.items():
        df = queries[name](spark, str(DATA))
        columns = sorted(df.columns)
        ours = sorted(str(tuple(r)) for r in df.select(*columns).collect())
        result = con.execute(text)
        names = [c[0] for c in result.description]
        if sorted(names) != columns:
            bad.append((name, columns, names))
            continue
        order = [names.index(c) for c in columns]
        theirs = sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())
        if ours != theirs:
            bad.append((name, len(ours), len(theirs), list(set(ours) ^ set(theirs))[:3]))
    return bad
