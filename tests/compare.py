"""Rows of a DataFrame and of a DuckDB query, made comparable."""


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in done.fetchall()), key=repr)
