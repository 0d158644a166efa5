"""What several test modules use."""

import os

SF = "/root/testdata/sf0.001"


def rows(df):
    """The rows as sorted text, columns by name."""
    columns = sorted(df.columns)
    return sorted(repr([row[c] for c in columns]) for row in df.collect())


def oracle_rows(sql, sf_dir=SF):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return sorted(map(repr, map(list, con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall())))
