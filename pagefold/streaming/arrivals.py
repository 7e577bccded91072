"""Extension: snapshots that arrive in a directory are classified as they come.

A file stream of whole snapshots joins the static reference; each micro-batch
appends its classes.  Files above the size of a row belong to the batch reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.classify import classify


def arriving_pages(spark: SparkSession, directory: str, pagesize: int = 4096) -> DataFrame:
    """(dump_id, page_nr, content) of files as they arrive; ``dump_id`` is the path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(directory).filter("length > 0")
    last = F.floor((F.col("length") - 1) / pagesize).cast("int")
    pages = F.transform(F.sequence(F.lit(0), last), lambda p: F.substr("content", p * pagesize + 1, F.lit(pagesize)))
    return files.select(F.col("path").alias("dump_id"), F.posexplode(pages).alias("page_nr", "content")).withColumn("page_nr", F.col("page_nr").cast("long"))


def classify_arrivals(pages: DataFrame, ref: DataFrame, target: str, checkpoint: str, delta: int | None = None):
    """Starts a query that appends (dump_id, page_nr, cls, first_nr) to a Parquet table."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        classify(rows, ref, delta=delta, arrow=delta is not None).select("dump_id", "page_nr", "cls", "first_nr").write.mode("append").parquet(target)

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
