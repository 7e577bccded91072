"""Archives: the interchange file format, and Parquet tables.

The file is one ordered stream, so it is written and read on the driver, piece
by piece from sorted section tables; classification and reconstruction stay
distributed.  ``write_tables``/``read_tables`` keep an archive as Parquet, with
the reference's checksum, and need no such step.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codec
from ..functions.codec import FormatError, Method, Reader
from ..operators import restore, sections
from ..operators.classify import classify
from .dump import publish, read_pages, size

DIFF_PAGE = codec.PATCH_PAGE


def checksum(pages: DataFrame) -> str:
    """A digest of all pages and their places, whatever the partitioning."""
    row = pages.agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring(F.sha2(F.concat(F.col("page_nr").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("content")), 256), k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 13, 25, 37))).first()
    import hashlib

    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key, its intervals in order; keys by first place or number."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("intervals"))


def _body(out, src: DataFrame, classified: DataFrame, method: Method, ref_path: str, short_off_limit: int) -> None:
    out.write(codec.text(ref_path))
    dedup = sections.dedup_section(classified)
    numbers = [r.first_nr for r in dedup.select("first_nr").distinct().orderBy("first_nr").toLocalIterator()]
    out.write(codec.page_numbers(numbers))
    for r in _groups(dedup, "first_nr").orderBy("first_nr").toLocalIterator():
        out.write(codec.interval_list([(x.left, x.right) for x in r.intervals]))
    if method.delta:
        diffs = sections.diff_section(classified).orderBy("page_nr")
        out.write(codec.page_numbers([r.page_nr for r in diffs.select("page_nr").toLocalIterator()]))
        for r in diffs.toLocalIterator():
            out.write(codec.diff([(p.rel_off, bytes(p.bytes)) for p in r.patches], short_off_limit))
    if method.intra:
        new = _groups(sections.new_section(classified), "content").withColumn("first", F.col("intervals")[0]["left"]).orderBy("first")
        out.write(new.count().to_bytes(4, "little"))
        for r in new.select("intervals").toLocalIterator():
            out.write(codec.interval_list([(x.left, x.right) for x in r.intervals]))
        for r in new.select("content").toLocalIterator():
            out.write(r.content)
    else:
        new = classified.filter("cls = 'NEW'")
        runs = sections.intervalize(new.withColumn("one", F.lit(1)), "one").orderBy("left")
        out.write(codec.interval_list([(r.left, r.right) for r in runs.toLocalIterator()]))
        for r in new.orderBy("page_nr").select("content").toLocalIterator():
            out.write(r.content)


def compress(spark: SparkSession, ref_path: str, src_path: str, target: str, pagesize: int = 4096, intra: bool = True, delta: bool = False, inner: str = "", level: int = 9, mode: str = "errorifexists", ref: DataFrame | None = None, short_off_limit: int = 256) -> DataFrame:
    """Writes ``target`` and returns the classified pages.  A short last page is NEW unless it is equal."""
    method = Method("interdedup", intra, delta, inner)
    name = str(method)
    if delta and pagesize > DIFF_PAGE:
        raise FormatError("diffs of pages above 4096 bytes do not fit the format; use write_tables")
    src = read_pages(spark, src_path, pagesize)
    ref = read_pages(spark, ref_path, pagesize) if ref is None else ref
    classified = classify(src, ref, delta=pagesize if delta else None, short_off_limit=short_off_limit, arrow=True).persist()

    def write(part):
        with open(part, "ab") as f:
            f.write(codec.header(name, pagesize, size(src)))
        with codec.opener(part, inner, level) as out:
            _body(out, src, classified, method, ref_path, short_off_limit)

    publish(target, mode, write)
    return classified


def read_archive(path: str) -> dict:
    """All sections of an archive file of any kind."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(raw: bytes) -> dict:
    r = Reader(raw)
    head = codec.read_header(r)
    method = Method.parse(head["method"])
    body = Reader(codec.decompress(raw[r.at :], method.inner))
    page, total = head["pagesize"], head["uncompressed_size"]
    n_pages = -(-total // page)
    length = lambda nr: total - page * nr if nr == n_pages - 1 else page
    out = head | {"kind": method.kind, "n_pages": n_pages, "dedup": [], "diffs": [], "new": [], "fills": [], "literals": []}
    if method.kind == "whole":
        return out | {"content": body.raw}
    if method.kind == "intradedup":
        contents = []
        n = body.little(4)
        contents = [body.take(page) for _ in range(n)] if n else []
        out["fills"] = [(c, codec.read_interval_list(body)) for c in contents]
        while not body.over:
            out["literals"].append(body.take(min(page, len(body.raw) - body.at)))
        return out
    out["ref_path"] = body.text()
    numbers = codec.read_page_numbers(body)
    out["dedup"] = [(nr, codec.read_interval_list(body)) for nr in numbers]
    if method.delta:
        places = codec.read_page_numbers(body)
        out["diffs"] = [(nr, codec.read_diff(body)) for nr in places]
    if body.over:  # an archive without new pages may end here
        return out
    if method.intra:
        lists = [codec.read_interval_list(body) for _ in range(body.little(4))]
        out["new"] = [(body.take(length(x[0][0])), x) for x in lists]
    else:
        runs = codec.read_interval_list(body)
        out["new"] = [(body.take(length(nr)), [(nr, nr)]) for a, b in runs for nr in range(a, b + 1)]
    return out


def section_tables(spark: SparkSession, a: dict) -> dict[str, DataFrame]:
    flat = lambda rows: [(k, x, y) for k, runs in rows for x, y in runs]
    diffs = []
    for nr, patches in a["diffs"]:
        at, out = 0, []
        for off, b in patches:
            at += off
            out.append((at, off, len(b), bytearray(b)))
            at += len(b)
        diffs.append((nr, out))
    frame = spark.createDataFrame
    return {
        "dedup": frame(flat(a["dedup"]), "first_nr long, left long, right long"),
        "diffs": frame(diffs, "page_nr long, patches array<struct<off:int,rel_off:int,len:int,bytes:binary>>"),
        "new": frame(flat(a["new"]), "content binary, left long, right long"),
        "fills": frame(flat(a["fills"]), "content binary, left long, right long"),
        "literals": frame([(k + 1, x) for k, x in enumerate(a["literals"])], "k long, content binary"),
    }


def decompress(spark: SparkSession, path: str, target: str | None = None, ref: DataFrame | None = None, mode: str = "errorifexists") -> DataFrame:
    """The pages of an archive file; written to ``target`` if that is given."""
    from .dump import write_pages

    a = read_archive(path)
    if a["kind"] == "whole":
        page = a["pagesize"] or 4096
        pages = spark.createDataFrame([(k // page, a["content"][k : k + page]) for k in range(0, len(a["content"]), page)], "page_nr long, content binary")
    else:
        t = section_tables(spark, a)
        if a["kind"] == "intradedup":
            pages = restore.intra_reconstruct(spark.range(a["n_pages"]).withColumnRenamed("id", "page_nr"), t["fills"], t["literals"])
        else:
            ref = read_pages(spark, a["ref_path"], a["pagesize"]) if ref is None else ref
            pages = restore.reconstruct(a["n_pages"], ref, t["dedup"], t["diffs"], t["new"])
    if target is not None:
        write_pages(pages, target, mode)
    return pages


def compress_intra(spark: SparkSession, src_path: str, target: str, pagesize: int = 4096, inner: str = "", level: int = 9, mode: str = "errorifexists") -> None:
    """Deduplicates a snapshot against itself."""
    name = str(Method("intradedup", inner=inner))
    src = read_pages(spark, src_path, pagesize).persist()
    fills, literals = sections.intra_split(src)
    groups = _groups(fills, "content").withColumn("first", F.col("intervals")[0]["left"]).orderBy("first")

    def write(part):
        with open(part, "ab") as f:
            f.write(codec.header(name, pagesize, size(src)))
        with codec.opener(part, inner, level) as out:
            out.write(groups.count().to_bytes(4, "little"))
            for r in groups.select("content").toLocalIterator():
                out.write(r.content)
            for r in groups.select("intervals").toLocalIterator():
                out.write(codec.interval_list([(x.left, x.right) for x in r.intervals]))
            for r in literals.orderBy("page_nr").select("content").toLocalIterator():
                out.write(r.content)

    try:
        publish(target, mode, write)
    finally:
        src.unpersist()


def compress_whole(src_path: str, target: str, inner: str, level: int = 9, mode: str = "errorifexists", pagesize: int = 4096) -> None:
    """A plain compressed file behind a header."""
    name = str(Method("whole", inner=inner))

    def write(part):
        with open(part, "ab") as f:
            f.write(codec.header(name, pagesize, os.path.getsize(src_path)))
        with codec.opener(part, inner, level) as out, open(src_path, "rb") as f:
            while piece := f.read(1 << 20):
                out.write(piece)

    publish(target, mode, write)


def write_tables(classified: DataFrame, ref: DataFrame, path: str, meta: dict, mode: str = "errorifexists") -> None:
    """The archive as Parquet tables below ``path``."""
    spark = ref.sparkSession
    sections.dedup_section(classified).write.mode(mode).parquet(f"{path}/dedup")
    sections.diff_section(classified).write.mode(mode).parquet(f"{path}/diffs")
    sections.new_section(classified).write.mode(mode).parquet(f"{path}/new")
    n = classified.count()
    spark.createDataFrame([meta | {"n_pages": n, "ref_sha2": checksum(ref)}]).write.mode(mode).parquet(f"{path}/meta")


def read_tables(spark: SparkSession, path: str, ref: DataFrame) -> DataFrame:
    """The pages of such an archive; the reference must be the one it was made with."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.ref_sha2 != checksum(ref):
        raise FormatError("another reference")
    return restore.reconstruct(meta.n_pages, ref, *(spark.read.parquet(f"{path}/{t}") for t in ("dedup", "diffs", "new")))
