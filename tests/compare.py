"""Compare a Spark result with a DuckDB result as bags of rows."""

from collections import Counter


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    extra, missing = got - want, want - got
    assert not extra and not missing, f"extra {list(extra.items())[:3]}, missing {list(missing.items())[:3]}"
