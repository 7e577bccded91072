"""Byte-level diffs of two pages of equal size.

A diff is an array of patches (off, rel_off, len, bytes): maximal runs of
differing bytes, a gap of at most two equal bytes being absorbed, cut into
pieces of at most 2048.  ``off`` is absolute, ``rel_off`` counts from the end of
the patch before.  ``patches`` is built of row-local expressions and works on
strings and binaries; ``patches_arrow`` gives the same for binary pages from
numpy, which is faster on large pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed values of the format.
GAP, LONGEST, HEADER = 2, 2048, 2
PATCH = "array<struct<off:int,rel_off:int,len:int,bytes:binary>>"


def _at(x: Column, k: Column) -> Column:
    return F.get(x, k)


def patches(new: str, old: str, page: int) -> Column:
    a, b = F.col(new), F.col(old)
    differing = F.filter(F.sequence(F.lit(1), F.lit(page)), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    # an array of one element binds a value once for the lambdas below
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def runs(d: Column) -> Column:
        begins = F.filter(d, lambda x, k: (k == 0) | (x - _at(d, k - 1) > GAP + 1))
        ends = F.filter(d, lambda x, k: (k == F.size(d) - 1) | (_at(d, k + 1) - x > GAP + 1))
        return F.zip_with(begins, ends, lambda s, e: F.struct((s - 1).alias("off"), (e - s + 1).alias("len")))

    def pieces(r: Column) -> Column:
        cut = F.transform(r, lambda x: F.transform(F.sequence(F.lit(0), F.floor((x["len"] - 1) / LONGEST).cast("int")), lambda k: F.struct((x["off"] + k * LONGEST).alias("off"), F.least(F.lit(LONGEST), x["len"] - k * LONGEST).alias("len"))))
        return F.flatten(cut)

    def placed(r: Column) -> Column:
        before = lambda k: F.when(k == 0, 0).otherwise(_at(r, k - 1)["off"] + _at(r, k - 1)["len"])
        return F.transform(r, lambda x, k: F.struct(x["off"].alias("off"), (x["off"] - before(k)).alias("rel_off"), x["len"].alias("len"), a.substr(x["off"] + 1, x["len"]).cast("binary").alias("bytes")))

    return bind(differing, lambda d: bind(runs(d), lambda r: bind(pieces(r), placed)))


def find_patches(new: bytes, old: bytes) -> list[tuple[int, int, int, bytes]]:
    """(off, rel_off, len, bytes) of one page."""
    d = np.flatnonzero(np.frombuffer(new, np.uint8) != np.frombuffer(old, np.uint8))
    if not len(d):
        return []
    breaks = np.flatnonzero(np.diff(d) > GAP + 1)
    begins, ends = d[np.append(0, breaks + 1)].tolist(), (d[np.append(breaks, len(d) - 1)] + 1).tolist()
    out, done = [], 0
    for s, e in zip(begins, ends):
        for at in range(s, e, LONGEST):
            n = min(LONGEST, e - at)
            out.append((at, at - done, n, new[at : at + n]))
            done = at + n
    return out


def patches_arrow(new: str, old: str) -> Column:
    @F.pandas_udf(PATCH)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("off", "rel_off", "len", "bytes")
        return pd.Series([None if x is None or y is None or len(x) != len(y) else [dict(zip(names, p)) for p in find_patches(bytes(x), bytes(y))] for x, y in zip(a, b)])

    return run(F.col(new).cast("binary"), F.col(old).cast("binary"))


def header_size(rel_off: Column, length: Column, short_off_limit: int) -> Column:
    return F.when((rel_off < short_off_limit) & (length <= 128), 2).otherwise(3)


def size(p: Column, short_off_limit: int = 256) -> Column:
    """Encoded bytes of a diff, by arithmetic."""
    return F.aggregate(p, F.lit(HEADER), lambda n, x: n + header_size(x["rel_off"], x["len"], short_off_limit) + x["len"])


def apply(page: str, p: str) -> Column:
    """The page with its patches laid over it."""
    zero = F.col(page).cast("binary")
    return F.aggregate(F.col(p), zero, lambda acc, x: F.overlay(acc, x["bytes"], x["off"] + 1, x["len"]))
