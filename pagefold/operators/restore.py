"""Snapshots rebuilt from archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import diff
from .intervals import expand, running


def apply_diffs(diffs: DataFrame, ref: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, page_nr, content) of diffed pages."""
    joined = diffs.join(ref.select(*on, "page_nr", F.col("content").alias("ref_content")), [*on, "page_nr"])
    return joined.select(*on, "page_nr", diff.apply("ref_content", "patches").cast(ref.schema["content"].dataType).alias("content"))


def reconstruct(n_pages: int, ref: DataFrame, dedup: DataFrame, diffs: DataFrame, new: DataFrame) -> DataFrame:
    """(page_nr, content) of one snapshot: filled, else diffed, else new, else the reference's page."""
    spark = ref.sparkSession
    filled = expand(dedup).select("page_nr", "first_nr")
    filled = filled.join(ref.select(F.col("page_nr").alias("first_nr"), F.col("content").alias("c1")), "first_nr").select("page_nr", "c1")
    diffed = apply_diffs(diffs, ref).withColumnRenamed("content", "c2")
    fresh = expand(new).select("page_nr", F.col("content").alias("c3"))
    place = spark.range(n_pages).withColumnRenamed("id", "page_nr")
    out = place.join(filled, "page_nr", "left").join(diffed, "page_nr", "left").join(fresh, "page_nr", "left").join(ref.select("page_nr", F.col("content").alias("c4")), "page_nr", "left")
    return out.select("page_nr", F.coalesce("c1", "c2", "c3", "c4").alias("content"))


def intra_reconstruct(places: DataFrame, fills: DataFrame, literals: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Fills where there are any, and the literals, in their order, at the places left over.

    Literals carry their rank ``k``, and free places are ranked the same way.
    """
    filled = expand(fills).select(*on, "page_nr", "content")
    free = places.join(filled.select(*on, "page_nr"), [*on, "page_nr"], "left_anti")
    return filled.unionByName(running(free, F.lit(1), "k", on).join(literals.select(*on, "k", "content"), [*on, "k"]).select(*on, "page_nr", "content"))
