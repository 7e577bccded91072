"""The archive as tables: dedup, diff and new pages of classified pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .intervals import intervalize


def dedup_section(classified: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, first_nr, left, right): the reference page that fills each interval."""
    return intervalize(classified.filter("cls = 'DEDUP'"), "first_nr", on)


def diff_section(classified: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    return classified.filter("cls = 'DIFF'").select(*on, "page_nr", "patches")


def new_section(classified: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, content, left, right): places of each distinct new page."""
    return intervalize(classified.filter("cls = 'NEW'"), "content", on)


def dedup_groups(classified: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    return dedup_section(classified, on).groupBy(*on, "first_nr").agg(F.sum(F.col("right") - F.col("left") + 1).alias("n"), F.count("*").alias("n_intervals"), F.min("left").alias("first_place"), F.max("right").alias("last_place"))


def new_groups(classified: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    return classified.filter("cls = 'NEW'").groupBy(*on, "content").agg(F.min("page_nr").alias("first_place"), F.count("*").alias("n"))


def intra_dictionary(pages: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Contents that occur at least twice, with their first place."""
    return pages.groupBy(*on, "content").agg(F.min("page_nr").alias("first_nr"), F.count("*").alias("n")).filter("n > 1")


def intra_split(pages: DataFrame, on: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(fills: on, content, left, right) and (literals: on, page_nr, content) of one snapshot by itself."""
    often = intra_dictionary(pages, on).select(*on, "content")
    return intervalize(pages.join(often, [*on, "content"], "left_semi"), "content", on), pages.join(often, [*on, "content"], "left_anti")
