"""Binary snapshots as page tables, and back.

``PageDump`` is a Spark data source: ``spark.read.format("pagedump")
.option("pagesize", 4096).load(path)`` reads byte ranges of one file in
parallel and numbers pages by their offset, so there is neither a shuffle nor a
size limit.  The short last page is kept.  ``path`` may be local or any URI
pyarrow can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pagesize = options["path"], int(options.get("pagesize", 4096))
        if self.pagesize < 1:
            raise ValueError("pagesize")
        pages = max(1, int(options.get("split", SPLIT)) // self.pagesize)
        self.step = pages * self.pagesize

    def partitions(self):
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if not info.is_file:
            raise FileNotFoundError(self.path)
        return [Range(k, min(k + self.step, info.size)) for k in range(0, info.size, self.step)] or [Range(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(self.path)
        per = max(1, (4 << 20) // self.pagesize)
        with system.open_input_file(path) as f:
            for at in range(partition.start, partition.end, per * self.pagesize):
                raw = f.read_at(min(per * self.pagesize, partition.end - at), at)
                pages = [raw[k : k + self.pagesize] for k in range(0, len(raw), self.pagesize)]
                first = at // self.pagesize
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(pages)), pa.int64()), pa.array(pages, pa.binary())], ["page_nr", "content"])


class PageDump(DataSource):
    @classmethod
    def name(cls):
        return "pagedump"

    def schema(self):
        return "page_nr bigint, content binary"

    def reader(self, schema):
        return PageReader(self.options)


def read_pages(spark: SparkSession, path: str, pagesize: int = 4096, full_only: bool = False, split: int = SPLIT) -> DataFrame:
    """(page_nr, content); ``full_only`` leaves out a short last page."""
    spark.dataSource.register(PageDump)
    pages = spark.read.format("pagedump").option("pagesize", pagesize).option("split", split).load(path)
    return pages.filter(F.length("content") == pagesize) if full_only else pages


def size(pages: DataFrame) -> int:
    return pages.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]


def publish(path: str, mode: str, write) -> None:
    """Writes beside the target and renames; ``mode`` is errorifexists or overwrite."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(mode)
    if mode == "errorifexists" and os.path.exists(path) and os.path.getsize(path):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.processing"
    with open(part, "wb"):
        pass
    try:
        write(part)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def write_pages(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes one file of pages numbered from 0, all of one size but for a shorter last one.

    Every task writes its pages at their places, so there is neither a sort nor a way through the
    driver; a task that is run again writes the same bytes.  ``path`` is on a file system that the
    driver and all executors share; a task that does not find the file fails.
    """
    measured = pages.agg(F.count("*").alias("n"), F.max("page_nr").alias("last"), F.max(F.length("content")).alias("page"), F.sum(F.length("content")).alias("bytes"), F.max_by(F.length("content"), "page_nr").alias("tail")).first()
    if measured.n and (measured.last != measured.n - 1 or measured.bytes != (measured.n - 1) * measured.page + measured.tail):
        raise ValueError("pages are not numbered from 0 without gaps, or one but the last is short")

    def write(part):
        if not measured.n:
            return
        place = os.path.abspath(part)

        def run(batches):
            done = 0
            with open(place, "r+b", buffering=0) as f:
                for batch in batches:
                    numbers, contents = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                    ends = np.append(np.flatnonzero(np.diff(numbers) != 1) + 1, len(numbers))  # of runs of neighbours
                    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                        run_of = b"".join(contents[i:j])
                        done += os.pwrite(f.fileno(), run_of, int(numbers[i]) * measured.page) if run_of else 0
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["bytes"])

        os.truncate(part, measured.bytes)
        written = pages.select("page_nr", "content").mapInArrow(run, "bytes long").agg(F.sum("bytes")).first()[0]
        if written != measured.bytes:
            raise OSError(f"{written} bytes of {measured.bytes} were written")

    publish(path, mode, write)
