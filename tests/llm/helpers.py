import duckdb


def oracle(sql, folder, **tables):
    """The rows of sql by DuckDB over a folder's tables, as sorted tuples by column name; tables: data frames in place of some."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if t not in tables:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for k, v in tables.items():
        con.register(k, v)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return rows((dict(zip(names, r)) for r in out.fetchall()))


def rows(of):
    return sorted((tuple(v for _, v in sorted((r.asDict() if hasattr(r, "asDict") else r).items())) for r in of), key=str)


def thue_morse(n, a="a", b="b"):
    """A string of a and b whose polynomial hash modulo a power of two is that of the string with a and b swapped, if n is a multiple of 1,024."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))
