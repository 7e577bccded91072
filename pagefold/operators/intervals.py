"""Intervals of page numbers: runs of consecutive places with the same key.

A run begins where the page before does not have the same key, which is an
equi-join on the place; runs are then numbered along the snapshot by running
counts in two levels, within blocks of places and over the blocks.  No step
gathers the places of one key, so a content that fills a third of a snapshot is
no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16


def running(rows: DataFrame, value: Column, name: str, on: tuple[str, ...] = (), order: str = "page_nr") -> DataFrame:
    """``rows`` with the sum of ``value`` up to each along ``order``: within blocks of it, then over blocks.

    No task holds a whole snapshot, however long; ``order`` is unique for ``on``.
    """
    cut = rows.withColumn("__v", value).withColumn("__block", F.floor(F.col(order) / BLOCK))
    within = Window.partitionBy(*on, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*on).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = cut.groupBy(*on, "__block").agg(F.sum("__v").alias("__n")).select(*on, "__block", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__base"))
    return cut.withColumn("__k", F.sum("__v").over(within)).join(before, [*on, "__block"]).withColumn(name, F.col("__base") + F.col("__k")).drop("__v", "__block", "__base", "__k")


def previous(rows: DataFrame, name: str, on: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the page number of the row before each, null for the first; in two levels as ``running``."""
    cut = rows.withColumn("__block", F.floor(F.col("page_nr") / BLOCK))
    within = Window.partitionBy(*on, "__block").orderBy("page_nr")
    over = Window.partitionBy(*on).orderBy("__block")
    before = cut.groupBy(*on, "__block").agg(F.max("page_nr").alias("__last")).select(*on, "__block", F.lag("__last").over(over).alias("__base"))
    return cut.withColumn("__k", F.lag("page_nr").over(within)).join(before, [*on, "__block"]).withColumn(name, F.coalesce("__k", "__base")).drop("__block", "__base", "__k")


def intervalize(pages: DataFrame, key: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, key, left, right): maximal closed runs; each place has one row."""
    at = pages.select(*on, "page_nr", key)
    before = at.select(*on, (F.col("page_nr") + 1).alias("page_nr"), F.col(key).alias("__before"))
    joined = at.join(before, [*on, "page_nr"], "left")
    numbered = running(joined, (~F.col(key).eqNullSafe(F.col("__before"))).cast("long"), "__run", on)
    return numbered.groupBy(*on, "__run").agg(F.first(key).alias(key), F.min("page_nr").alias("left"), F.max("page_nr").alias("right")).drop("__run")


def expand(intervals: DataFrame) -> DataFrame:
    """A row with ``page_nr`` for each place of each interval."""
    return intervals.withColumn("page_nr", F.explode(F.sequence("left", "right"))).drop("left", "right")


def total(intervals: DataFrame, *by: str) -> DataFrame:
    return intervals.groupBy(*by).agg(F.sum(F.col("right") - F.col("left") + 1).cast("long").alias("total"))
