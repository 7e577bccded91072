"""Results of the two engines, in a form that compares."""

from __future__ import annotations


def _value(x):
    if isinstance(x, float):
        return round(x, 8)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_value(r[k]) for k in order) for r in data), key=repr)


def same(df, con, sql: str) -> None:
    """Equal column names and rows, whatever the order."""
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want
