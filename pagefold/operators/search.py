"""Signature search over deduplicated pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def signature_scan(pages: DataFrame, signature: Column, on: tuple[str, ...] = ()) -> DataFrame:
    """Places whose page holds a signature; each distinct page is searched once, then joined back to its places."""
    found = pages.select("content").distinct().filter(F.col("content").contains(signature))
    return pages.join(found, "content", "left_semi").select(*on, "page_nr")
