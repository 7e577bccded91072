"""The same codecs as Spark expressions, in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def big(value: Column, n: int) -> Column:
    """The low n bytes of a number, high byte first."""
    return F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n))


def little(value: Column, n: int) -> Column:
    """The low n bytes of a number, low byte first."""
    text = big(value, n)
    return F.concat(*(F.substring(text, 2 * k - 1, 2) for k in range(n, 0, -1)))


def page_gap(gap: Column) -> Column:
    return F.when(gap < 128, big(gap.bitwiseOR(F.lit(128)), 1)).otherwise(big(gap, 4))


def interval(left: Column, right: Column, last: Column) -> Column:
    span = right - left
    width = F.when(span == 0, 0).when(span < 256, 1).when(span < 65536, 2).otherwise(3)
    word = F.when(last, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + width.cast("long") * (1 << 29) + left
    tail = F.when(span == 0, "").when(span < 256, little(span, 1)).when(span < 65536, little(span, 2)).otherwise(little(span, 4))
    return F.concat(little(word, 4), tail)


def patch_header(rel_off: Column, length: Column, short_off_limit: int = 256) -> Column:
    long_ = F.lit(0x800000) + (length - 1).cast("long") * 4096 + rel_off
    return F.when((length <= 128) & (rel_off < short_off_limit), F.concat(big(length - 1, 1), big(rel_off, 1))).otherwise(big(long_, 3))


def diff(patches: Column, short_off_limit: int = 256) -> Column:
    parts = F.transform(patches, lambda p: F.concat(patch_header(p["rel_off"], p["len"], short_off_limit), F.hex(p["bytes"])))
    return F.concat(little(F.size(patches), 2), F.array_join(parts, ""))


def header(method: Column, pagesize: Column, size: Column) -> Column:
    return F.concat(F.hex(F.lit("MBCR")), F.lit("00"), F.hex(method), F.lit("00"), F.lit("02000100"), little(pagesize, 4), little(size, 8))


def number(text: Column) -> Column:
    """A hexadecimal number, low byte first; up to eight bytes."""
    swapped = F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))), "")
    return F.conv(swapped, 16, 10).cast("long")
