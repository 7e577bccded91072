"""Positional and content joins, and the class of every page.

A page is SAME if the reference has it at the same place, DEDUP if it has it
anywhere, DIFF if its byte-level diff against the reference's page at that
place is smaller than a page, else NEW.  All functions take several snapshots
at once: ``on`` names the columns that tell them apart.  The reference's
dictionary is distinct, so a content that fills half a snapshot cannot multiply
rows; contents are joined by a 64-bit hash and compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import diff


def dictionary(ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """The first place of each distinct content."""
    return ref.groupBy(*on, "content").agg(F.min("page_nr").alias("first_nr"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("__h", F.xxhash64("content"))


def same_offset(src: DataFrame, ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Positional join: ``same``, and where it is not, the reference's page at that place as ``ref_content`` (null beyond its end)."""
    other = ref.select(*on, "page_nr", F.col("content").alias("ref_content"))
    joined = src.join(other, [*on, "page_nr"], "left")
    joined = joined.withColumn("same", F.coalesce(F.col("content") == F.col("ref_content"), F.lit(False)))
    return joined.withColumn("ref_content", F.when(~F.col("same"), F.col("ref_content")))  # no equal page goes through a further shuffle


def membership(src: DataFrame, ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Content join: ``first_nr`` of the reference, null if it has no such page."""
    known = _hashed(dictionary(ref, on)).withColumnRenamed("content", "__c")
    hashed = _hashed(src)
    match = [hashed[c] == known[c] for c in (*on, "__h")] + [hashed["content"] == known["__c"]]
    return hashed.join(known, match, "left").select(*(hashed[c] for c in src.columns), "first_nr")


def in_reference(src: DataFrame, ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    return _against(src, ref, on, "left_semi")


def not_in_reference(src: DataFrame, ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    return _against(src, ref, on, "left_anti")


def _against(src: DataFrame, ref: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    """By the contents' hashes, and then in full."""
    a, b = _hashed(src), _hashed(ref.select(*on, "content").distinct())
    match = [a[c] == b[c] for c in (*on, "__h", "content")]
    return a.join(b, match, how).drop("__h")


def classify(src: DataFrame, ref: DataFrame, on: tuple[str, ...] = (), delta: int | None = None, short_off_limit: int = 256, arrow: bool = False) -> DataFrame:
    """Every source page with ``cls``, ``first_nr``, ``ref_content`` and, with ``delta`` (the page size), ``patches``.

    Diffs are made for candidates only: pages whose content the reference does not have.
    """
    placed = membership(same_offset(src, ref, on), ref, on)
    base = F.when(F.col("same"), "SAME").when(F.col("first_nr").isNotNull(), "DEDUP")
    if delta is None:
        return placed.withColumn("cls", base.otherwise("NEW")).drop("same")
    open_ = ~F.col("same") & F.col("first_nr").isNull() & F.col("ref_content").isNotNull() & (F.length("content") == delta) & (F.length("ref_content") == delta)
    patches = diff.patches_arrow("content", "ref_content") if arrow else diff.patches("content", "ref_content", delta)
    placed = placed.withColumn("patches", F.when(open_, patches))
    small = F.col("patches").isNotNull() & (diff.size(F.col("patches"), short_off_limit) < delta)
    return placed.withColumn("cls", base.when(small, "DIFF").otherwise("NEW")).withColumn("patches", F.when(F.col("cls") == "DIFF", F.col("patches"))).drop("same")
