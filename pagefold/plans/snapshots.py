"""Snapshots derived from tables, as page tables.

``line_items`` numbers all rows and cuts them into a reference and a source of
fixed 32-character pages; ``text_pages`` and ``line_pages`` make one small
snapshot of every document, paired with the first document that starts with the
same page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.shared import settle

PAGE = 32
TEXT_PAGE = 64
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
PARTS = 64

CONTENT = """rpad(CASE WHEN l_linenumber <= 2 THEN concat(l_returnflag, l_linestatus)
  WHEN l_linenumber <= 5 THEN concat(l_returnflag, l_linestatus, '-', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 4, '0'))
  ELSE concat(l_returnflag, l_linestatus, '-', lpad(CAST(l_partkey AS STRING), 12, '0'), '-', lpad(CAST(l_orderkey AS STRING), 14, '0')) END, 32, '.')"""


def _place(x: Column, cuts: list[float], before: int) -> Column:
    """How many of the sorted cuts are at or below ``x``, plus ``before``: a binary search of nested cases."""
    if not cuts:
        return F.lit(before)
    k = len(cuts) // 2
    return F.when(x >= cuts[k], _place(x, cuts[k + 1 :], before + k + 1)).otherwise(_place(x, cuts[:k], before))


def number(df: DataFrame, keys: tuple[str, ...], name: str = "page_nr") -> tuple[DataFrame, int]:
    """Numbers from 0 in the order of unique ``keys``, and the row count, without a single-task sort.

    Rows are dealt into ranges of the first key by sampled quantiles; a row's number is its rank in
    its range plus the rows of the ranges before.
    """
    lead = keys[0]
    cuts = sorted(set(df.approxQuantile(lead, [k / PARTS for k in range(1, PARTS)], 1 / (4 * PARTS))))
    part = _place(F.col(lead), cuts, 0)
    dealt = df.withColumn("__part", part)
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # at most PARTS rows
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in starts for x in pair)), F.col("__part").cast("long")) if starts else F.lit(0).cast("long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.withColumn(name, start + rank - 1).drop("__part"), total


def numbered_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(page_nr, content) of all of ``lineitem``, and their number; a table that the query's branches read."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, F.expr(CONTENT).alias("content"))
    pages, n = number(rows, ORDER)
    return settle(pages.select("page_nr", "content")), n


def line_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source and reference pages: (page_nr, content)."""
    pages, n = numbered_items(spark, sf_dir)
    half = n // 2
    return pages.filter(F.col("page_nr") >= half).select((F.col("page_nr") - half).alias("page_nr"), "content"), pages.filter(F.col("page_nr") < half)


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dump_id, page_nr, content): every document in pages of 64 characters, the tail kept short."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("dump_id"), "text").filter("length(text) > 0")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_PAGE}}}"), F.lit(0))  # one walk; substr would start over for each page
    return docs.select("dump_id", F.posexplode(cut).alias("page_nr", "content")).withColumn("page_nr", F.col("page_nr").cast("long"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dump_id, page_nr, content): a page is a line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("dump_id"), "text").filter("text IS NOT NULL")
    return docs.select("dump_id", F.posexplode(F.split("text", "\n", -1)).alias("page_nr", "content")).withColumn("page_nr", F.col("page_nr").cast("long"))


def pairs(pages: DataFrame) -> DataFrame:
    """(dump_id, ref_id): the smallest snapshot with the same first page, where that is another one."""
    first = pages.filter("page_nr = 0").select("dump_id", "content")
    lead = first.groupBy("content").agg(F.min("dump_id").alias("ref_id"))
    return first.join(lead, "content").filter("dump_id <> ref_id").select("dump_id", "ref_id")
