"""Spark rows against DuckDB rows: equal as sets with repeats, columns by name."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(df, relation):
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(relation.columns, relation.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
