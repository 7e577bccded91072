"""One query for each operator of the engine, over the snapshots of ``snapshots``."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import codec, hexcode, small
from ..functions.codec import Method, Reader
from ..operators import diff, intervals, restore, search, sections, stats
from ..operators import classify as cl
from ..sources.shared import scratch, settle
from . import snapshots as sn

PAGE = sn.PAGE


def _items(spark, sf):
    return sn.line_items(spark, sf)


def _all_items(spark, sf) -> DataFrame:
    return sn.numbered_items(spark, sf)[0]


def _delta(spark, sf) -> DataFrame:
    return cl.classify(*_items(spark, sf), delta=PAGE)


def _many(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All snapshots, and the references of those that have one, under the source's id."""
    pairs = sn.pairs(pages)
    return pages, pages.withColumnRenamed("dump_id", "ref_id").join(pairs, "ref_id").drop("ref_id")


def _many_classes(pages: DataFrame) -> DataFrame:
    return cl.classify(*_many(pages), on=("dump_id",))


def page_scan(spark, sf):
    return sn.text_pages(spark, sf)


def page_scan_full(spark, sf):
    return sn.text_pages(spark, sf).filter(F.length("content") == sn.TEXT_PAGE)


def dump_size(spark, sf):
    return sn.text_pages(spark, sf).groupBy("dump_id").agg(F.sum(F.length("content")).alias("size"), F.count("*").alias("pages"))


def page_enumerate(spark, sf):
    return sn.numbered_items(spark, sf)[0]


def distinct_pages(spark, sf):
    return _all_items(spark, sf).select("content").distinct()


def content_index(spark, sf):
    return _all_items(spark, sf).groupBy("content").agg(F.count("*").alias("n"), F.min("page_nr").alias("first_nr"), F.max("page_nr").alias("last_nr"))


def first_occurrence(spark, sf):
    return cl.dictionary(_all_items(spark, sf))


def inverse_map(spark, sf):
    return intervals.expand(intervals.intervalize(_all_items(spark, sf), "content")).select("page_nr", "content")


def same_offset(spark, sf):
    return cl.same_offset(*_items(spark, sf)).select("page_nr", "same")


def dedup_membership(spark, sf):
    return cl.membership(*_items(spark, sf)).select("page_nr", F.coalesce("first_nr", F.lit(-1)).alias("first_nr"), F.col("first_nr").isNotNull().alias("in_ref"))


def pages_in_ref(spark, sf):
    return cl.in_reference(*_items(spark, sf)).select("page_nr")


def pages_not_in_ref(spark, sf):
    return cl.not_in_reference(*_items(spark, sf)).select("page_nr", "content")


def dedup_positions(spark, sf):
    return cl.classify(*_items(spark, sf)).filter("cls = 'DEDUP'").select("first_nr", "page_nr")


def classify(spark, sf):
    return _many_classes(sn.text_pages(spark, sf)).select("dump_id", "page_nr", "cls", F.coalesce("first_nr", F.lit(-1)).alias("first_nr"))


def classify_lines(spark, sf):
    return _many_classes(sn.line_pages(spark, sf)).select("dump_id", "page_nr", "cls", F.coalesce("first_nr", F.lit(-1)).alias("first_nr"))


def _patches(spark, sf) -> DataFrame:
    """All diffs of candidates, kept or not."""
    src, ref = _items(spark, sf)
    rest = cl.classify(src, ref).filter("cls = 'NEW' AND ref_content IS NOT NULL")
    return rest.select("page_nr", diff.patches("content", "ref_content", PAGE).alias("patches"))


def _each_patch(rows: DataFrame) -> DataFrame:
    return rows.select("page_nr", F.posexplode("patches").alias("patch_nr", "p"))


def byte_diff(spark, sf):
    return _each_patch(_patches(spark, sf)).select("page_nr", F.col("patch_nr").cast("long").alias("patch_nr"), F.col("p.rel_off").cast("long").alias("rel_off"), F.col("p.len").cast("long").alias("len"), F.col("p.bytes").cast("string").alias("bytes"))


def patch_split(spark, sf):
    """Pages that differ from their reference in the first 200 * p_size bytes."""
    pages = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr("rpad(repeat('b', 200 * p_size), 16384, 'a')").cast("binary").alias("content"), F.expr("repeat('a', 16384)").cast("binary").alias("ref_content"))
    cut = pages.select("p_partkey", F.posexplode(diff.patches_arrow("content", "ref_content")).alias("piece", "p"))
    return cut.select("p_partkey", F.col("piece").cast("long").alias("piece"), F.col("p.len").cast("long").alias("len"))


def diff_size(spark, sf):
    return _patches(spark, sf).select("page_nr", diff.size(F.col("patches")).cast("long").alias("size_256"), diff.size(F.col("patches"), 128).cast("long").alias("size_128"))


def diff_accept(spark, sf):
    return _patches(spark, sf).filter(diff.size(F.col("patches")) < PAGE).select("page_nr")


def classify_delta(spark, sf):
    return stats.class_summary(_delta(spark, sf))


def diff_list(spark, sf):
    return sections.diff_section(_delta(spark, sf)).select("page_nr", F.size("patches").cast("long").alias("n_patches"), diff.size(F.col("patches")).cast("long").alias("size"))


def intervalize(spark, sf):
    return intervals.intervalize(_all_items(spark, sf), "content").select("content", "left", "right")


def interval_expand(spark, sf):
    return intervals.expand(sections.dedup_section(cl.classify(*_items(spark, sf)))).select("first_nr", "page_nr")


def interval_total(spark, sf):
    return intervals.total(sections.dedup_section(cl.classify(*_items(spark, sf))), "first_nr")


def dedup_groups(spark, sf):
    return sections.dedup_groups(_delta(spark, sf))


def new_groups(spark, sf):
    return sections.new_groups(_delta(spark, sf))


def inter_stats(spark, sf):
    return stats.inter_stats(_delta(spark, sf))


def decode_stats(spark, sf):
    return stats.decode_stats(_delta(spark, sf))


def intra_stats(spark, sf):
    return stats.intra_stats(_all_items(spark, sf))


def progress(spark, sf):
    pages = sn.text_pages(spark, sf).select("dump_id", "page_nr", F.length("content").alias("n"))
    done = intervals.running(pages, F.col("n"), "done", ("dump_id",))
    return done.join(pages.groupBy("dump_id").agg(F.sum("n").alias("whole")), "dump_id").select("dump_id", "page_nr", (100 * F.col("done") / F.col("whole")).alias("percent"))


def diff_apply(spark, sf):
    src, ref = _items(spark, sf)
    return restore.apply_diffs(sections.diff_section(_delta(spark, sf)), ref)


def reconstruct(spark, sf):
    src, ref = _items(spark, sf)
    classified, n = settle(cl.classify(src, ref, delta=PAGE), F.count("*"))  # three sections are made of it
    return restore.reconstruct(n, ref, sections.dedup_section(classified), sections.diff_section(classified), sections.new_section(classified))


def intra_dictionary(spark, sf):
    return sections.intra_dictionary(_all_items(spark, sf))


def intra_reconstruct(spark, sf):
    pages = settle(sn.text_pages(spark, sf))  # cut once for all that is made of them
    fills, literals = sections.intra_split(pages, ("dump_id",))
    ranked = intervals.running(literals, F.lit(1), "k", ("dump_id",)).drop("page_nr")
    return restore.intra_reconstruct(pages.select("dump_id", "page_nr"), fills, ranked, ("dump_id",))


def interval_encode(spark, sf):
    rows = settle(sections.dedup_section(cl.classify(*_items(spark, sf))))
    last = rows.groupBy("first_nr").agg(F.max("left").alias("last"))
    return rows.join(last, "first_nr").select("first_nr", "left", "right", (F.col("left") == F.col("last")).alias("last")).withColumn("code", hexcode.interval(F.col("left"), F.col("right"), F.col("last"))).drop("last")


def _gaps(spark, sf) -> DataFrame:
    new = _many_classes(sn.text_pages(spark, sf)).filter("cls = 'NEW'")
    ranked = intervals.running(intervals.previous(new.select("dump_id", "page_nr"), "before", ("dump_id",)), F.lit(1), "ord", ("dump_id",))
    return ranked.select("dump_id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("page_nr") - F.col("before") - 1, F.col("page_nr")).alias("gap"))


def pagenr_list(spark, sf):
    return _gaps(spark, sf).withColumn("code", hexcode.page_gap(F.col("gap"))).drop("gap")


def pagenr_list_decode(spark, sf):
    code = pagenr_list(spark, sf)
    gap = F.conv("code", 16, 10).cast("long")
    gap = F.when(F.length("code") == 2, gap - 128).otherwise(gap)
    return intervals.running(code, gap + 1, "n", ("dump_id",), "ord").select("dump_id", (F.col("n") - 1).alias("page_nr"))


def patch_encode(spark, sf):
    return _each_patch(_patches(spark, sf)).select("page_nr", F.col("patch_nr").cast("long").alias("patch_nr"), hexcode.patch_header(F.col("p.rel_off"), F.col("p.len")).alias("code"))


def diff_encode(spark, sf):
    return sections.diff_section(_delta(spark, sf)).select("page_nr", hexcode.diff(F.col("patches")).alias("code"))


def diff_decode(spark, sf):
    def run(batches):
        for batch in batches:
            rows = [(nr, k, off, len(b), b.decode()) for nr, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (off, b) in enumerate(codec.read_diff(Reader(bytes.fromhex(code))))]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_nr", "patch_nr", "rel_off", "len", "bytes"])

    return diff_encode(spark, sf).mapInArrow(run, "page_nr long, patch_nr long, rel_off long, len long, bytes string")


def le_be(spark, sf):
    n = F.col("n")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * 7919).alias("n"))
    coded = rows.select("n", hexcode.little(n, 4).alias("le4"), hexcode.big(n, 4).alias("be4"), hexcode.little(n, 8).alias("le8"))
    return coded.withColumn("decoded", hexcode.number(F.col("le8")))


def _headers(spark, sf) -> DataFrame:
    sizes = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey").cast("long") * 123456789).alias("size"))
    methods = F.array(*map(F.lit, codec.METHODS))
    return sizes.select(F.explode(methods).alias("method"), F.lit(4096).cast("long").alias("pagesize"), "size")


def header_encode(spark, sf):
    return _headers(spark, sf).withColumn("code", hexcode.header(F.col("method"), F.col("pagesize"), F.col("size")))


def header_decode(spark, sf):
    code = header_encode(spark, sf).select("code")
    parts = F.split(F.decode(F.unhex(F.expr("substring(code, 1, length(code) - 32)")), "US-ASCII"), "\u0000")
    at = lambda k, n: hexcode.number(F.expr(f"substring(code, length(code) - {k - 1}, {n})"))
    return code.select(parts[0].alias("magic"), parts[1].alias("method"), at(32, 4).alias("major"), at(28, 4).alias("minor"), at(24, 8).alias("pagesize"), at(16, 16).alias("size"))


def method_parse(spark, sf):
    m = spark.createDataFrame([(x,) for x in codec.METHODS], "method string")
    inter = m["method"].startswith("interdedup")
    return m.select("method", F.when(inter, "interdedup").when(m["method"].startswith("intradedup"), "intradedup").otherwise("whole").alias("kind"), (inter & ~m["method"].contains("nointra")).alias("intra"), (inter & m["method"].contains("delta")).alias("delta"), F.regexp_extract("method", "(gzip|bzip2|7zip)$", 1).alias("inner_codec"))


def binlen(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.length(F.bin("o_orderkey")).cast("long").alias("bits"))


def msg_padding(spark, sf):
    n = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (8 - n % 8).cast("long").alias("padding"), F.pmod(n, F.lit(256)).cast("long").alias("message_id"))


def archive_sections(spark, sf):
    classified = settle(_delta(spark, sf))
    span = F.col("right") - F.col("left")
    width = F.when(span == 0, 4).when(span < 256, 5).when(span < 65536, 6).otherwise(8)
    row = lambda df, name, size: df.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("section"), "entries", "bytes")
    new = sections.new_section(classified)
    return (
        row(sections.dedup_section(classified), "dedup intervals", width)
        .unionByName(row(sections.diff_section(classified), "diffs", diff.size(F.col("patches"))))
        .unionByName(row(new, "new intervals", width))
        .unionByName(row(sections.new_groups(classified), "new pages", F.length("content")))
    )


_HEX = "dump_id long, page_nr long, content_hex string"


def _archived(spark, sf, method_of) -> DataFrame:
    """Packs every document against its reference (nothing where it has none), as bytes, unpacks the archive and cuts it into pages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("dump_id"), F.col("text").cast("binary").alias("src"))
    pairs = sn.pairs(sn.text_pages(spark, sf))
    refs = docs.select(F.col("dump_id").alias("ref_id"), F.col("src").alias("ref"))
    both = docs.filter("length(src) > 0").join(pairs, "dump_id", "left").join(refs, "ref_id", "left").select("dump_id", "src", F.coalesce("ref", F.lit(b"")).alias("ref"))

    def run(batches):
        for batch in batches:
            out = []
            for dump, src, ref in zip(*(c.to_pylist() for c in batch.columns)):
                again = small.unpack(small.pack(src, ref, method_of(dump), sn.TEXT_PAGE, f"doc/{dump}"), ref)
                out += [(dump, k, p.hex().upper()) for k, p in enumerate(small.pages_of(again, sn.TEXT_PAGE))]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["dump_id", "page_nr", "content_hex"])

    return both.mapInArrow(run, _HEX)


def archive_parse(spark, sf):
    return _archived(spark, sf, lambda n: Method("interdedup", n % 2 == 0, n % 4 < 2))


def intra_parse(spark, sf):
    return _archived(spark, sf, lambda n: Method("intradedup"))


def inner_codec(spark, sf):
    return _archived(spark, sf, lambda n: Method("interdedup", inner=codec.INNER[n % 4]))


def intra_sections(spark, sf):
    fills, literals = sections.intra_split(sn.text_pages(spark, sf), ("dump_id",))
    a = fills.groupBy("dump_id").agg(F.count_distinct("content").alias("groups"), F.sum(F.col("right") - F.col("left") + 1).alias("filled"))
    b = literals.groupBy("dump_id").agg(F.count("*").alias("literals"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, "dump_id", "full").select("dump_id", zero("groups"), zero("filled"), zero("literals"))


def _whole(inner: str):
    def query(spark, sf):
        def run(batches):
            for batch in batches:
                sums = [hashlib.sha256(small.unpack(small.pack(x or b"", b"", Method("whole", inner=inner), 4096))).hexdigest() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["doc_id", "decoded_sha256"])

        return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, decoded_sha256 string")

    return query


def signature_scan(spark, sf):
    return search.signature_scan(_all_items(spark, sf), F.lit("O-001"))


def dump_write(spark, sf):
    """All items written as one binary file by many tasks, and scanned again in pages of 512 bytes, in ranges of 64 KB."""
    from ..sources.dump import read_pages, write_pages

    path = scratch(spark).removeprefix("file://")
    write_pages(_all_items(spark, sf).select("page_nr", F.col("content").cast("binary").alias("content")), path)
    return read_pages(spark, path, 512, split=1 << 16).select("page_nr", F.col("content").cast("string").alias("content"))


def dump_scan(spark, sf):
    """A binary file in pages of 512 bytes, by the data source."""
    from ..sources.dump import read_pages

    return read_pages(spark, f"{sf}/nation.parquet", 512).select("page_nr", F.length("content").cast("long").alias("size"))


def registry(spark, sf):
    """References after adding two, adding one again and deleting one."""
    from ..registry import Registry

    r = Registry(spark, 1)
    for name in ("nation", "region", "nation"):
        r.add_reference(f"{sf}/{name}.parquet", 512)
    r.del_reference(f"{sf}/region.parquet")
    rows = [(path.rpartition("/")[2], pagesize) for path, pagesize in r.references()]
    r.close()
    return spark.createDataFrame(rows, "reference string, pagesize long")


QUERIES = {
    f.__name__: f
    for f in (
        classify_delta, page_scan, page_scan_full, dump_size, page_enumerate, distinct_pages, content_index, first_occurrence, inverse_map, same_offset,
        dedup_membership, pages_in_ref, pages_not_in_ref, dedup_positions, classify, classify_lines, byte_diff, patch_split, diff_size, diff_accept,
        diff_list, intervalize, interval_expand, interval_total, dedup_groups, new_groups, inter_stats, decode_stats, intra_stats, progress,
        diff_apply, reconstruct, intra_dictionary, intra_reconstruct, interval_encode, pagenr_list, pagenr_list_decode, patch_encode, diff_encode,
        diff_decode, le_be, header_encode, header_decode, method_parse, binlen, msg_padding, archive_sections, archive_parse, intra_sections,
        intra_parse, inner_codec, signature_scan, dump_scan, dump_write, registry,
    )
} | {"codec_gzip": _whole("gzip"), "codec_bzip2": _whole("bzip2"), "codec_xz": _whole("7zip")}
