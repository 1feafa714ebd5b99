"""Results of Spark and DuckDB in one form."""


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name, numbers rounded."""

    def one(x):
        if x is None or x != x:
            return ""
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 6))
        return str(x)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(one(x) for x in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
