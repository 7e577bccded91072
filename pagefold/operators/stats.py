"""Totals and distinct counts per class: contents are grouped once, with a count for each class, and then added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _totals(classified: DataFrame, cases: dict) -> DataFrame:
    groups = classified.groupBy("content").agg(*(F.count_if(where).alias(name) for name, where in cases.items()))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    return groups.agg(*(x for name in cases for x in (total(name).alias(f"{name}_total"), F.count_if(F.col(name) > 0).alias(f"{name}_distinct"))))


def inter_stats(classified: DataFrame) -> DataFrame:
    """One row: totals and distinct contents of the classes, of dedup as a whole, and of all pages."""
    c = F.col("cls")
    cases = {"same": c == "SAME", "moved": c == "DEDUP", "dedup": c.isin("SAME", "DEDUP"), "diff": c == "DIFF", "new": c == "NEW", "all": F.lit(True)}
    return _totals(classified, cases)


def decode_stats(classified: DataFrame) -> DataFrame:
    """As the decoder sees it: distinct contents are counted without diffed pages."""
    c = F.col("cls")
    cases = {"filled": c == "DEDUP", "same": c == "SAME", "new": c == "NEW", "seen": c != "DIFF", "diff": c == "DIFF"}
    return _totals(classified, cases).drop("diff_distinct")


def intra_stats(pages: DataFrame) -> DataFrame:
    """Places in repeated groups of all places; repeated groups of all distinct contents."""
    groups = pages.groupBy("content").agg(F.count("*").alias("n"))
    often = F.col("n") > 1
    return groups.agg(F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).cast("long").alias("deduped"), F.sum("n").cast("long").alias("pages"), F.count(F.when(often, 1)).alias("groups"), F.count("*").alias("distinct_pages"))


def class_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("cls").agg(F.count("*").alias("total"), F.count_distinct("content").alias("distinct_contents"), F.coalesce(F.sum(F.size("patches")), F.lit(0)).cast("long").alias("patches"))
