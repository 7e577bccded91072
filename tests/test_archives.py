"""Binary snapshots through Spark: archives, tables, registry and arrivals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagefold.functions import codec, small
from pagefold.functions.codec import FormatError, Method
from pagefold.operators import diff, intervals
from pagefold.operators.classify import classify
from pagefold.registry import Registry
from pagefold.sources import archive
from pagefold.sources.dump import read_pages, size, write_pages

PAGE = 512


def snapshots(seed=3, pages=40):
    r = random.Random(seed)
    ref = [r.randbytes(PAGE) for _ in range(pages)]
    ref[5] = ref[6] = ref[9] = bytes(PAGE)
    src = list(ref)
    for k in range(0, pages, 7):
        src[k] = bytes(b ^ 1 if r.random() < 0.01 else b for b in src[k])
    for k in range(3, pages, 11):
        src[k] = r.randbytes(PAGE)
    src[20], src[21], src[22] = bytes(PAGE), ref[2], src[3]
    return b"".join(ref), b"".join(src) + ref[1] + r.randbytes(PAGE) + b"tail"


@pytest.fixture
def files(tmp_path):
    ref, src = snapshots()
    (tmp_path / "ref").write_bytes(ref)
    (tmp_path / "src").write_bytes(src)
    return tmp_path, ref, src


@pytest.mark.parametrize("intra, delta, inner", [(i, d, c) for i in (True, False) for d in (False, True) for c in codec.INNER])
def test_archive_round_trip(spark, files, intra, delta, inner):
    path, ref, src = files
    archive.compress(spark, str(path / "ref"), str(path / "src"), str(path / "out"), PAGE, intra, delta, inner, level=1)
    assert small.unpack((path / "out").read_bytes(), ref) == src
    if inner in ("", "gzip"):
        archive.decompress(spark, str(path / "out"), str(path / "again"))
        assert (path / "again").read_bytes() == src
        same = small.pack(src, ref, Method("interdedup", intra, delta, inner), PAGE, str(path / "ref"), level=1)
        assert archive.parse(same) == archive.parse((path / "out").read_bytes())


@pytest.mark.parametrize("inner", codec.INNER)
def test_intra_and_whole_files(spark, files, inner):
    path, _, src = files
    archive.compress_intra(spark, str(path / "src"), str(path / "intra"), PAGE, inner)
    archive.decompress(spark, str(path / "intra"), str(path / "one"))
    assert (path / "one").read_bytes() == src
    if inner:
        archive.compress_whole(str(path / "src"), str(path / "whole"), inner)
        archive.decompress(spark, str(path / "whole"), str(path / "two"))
        assert (path / "two").read_bytes() == src


@pytest.mark.parametrize("ref, src", [(b"", b"ab" * 700), (b"ab" * 700, b""), (b"x" * 2000, b"x" * 2000), (b"x" * 100, b"y" * 5000), (bytes(PAGE), bytes(PAGE * 2 + 1))])
@pytest.mark.parametrize("intra", [True, False])
def test_edges(spark, tmp_path, ref, src, intra):
    (tmp_path / "ref").write_bytes(ref)
    (tmp_path / "src").write_bytes(src)
    archive.compress(spark, str(tmp_path / "ref"), str(tmp_path / "src"), str(tmp_path / "out"), PAGE, intra, True, "gzip")
    archive.decompress(spark, str(tmp_path / "out"), str(tmp_path / "again"))
    assert (tmp_path / "again").read_bytes() == src


def test_tables_round_trip_and_guard_the_reference(spark, files):
    path, ref, src = files
    a, b = read_pages(spark, str(path / "src"), 8192), read_pages(spark, str(path / "ref"), 8192)
    for delta in (None, 8192):
        archive.write_tables(classify(a, b, delta=delta, arrow=True).withColumn("patches", F.col("patches") if delta else F.lit(None).cast(diff.PATCH)), b, str(path / "t"), {"pagesize": 8192}, "overwrite")
        again = archive.read_tables(spark, str(path / "t"), b).orderBy("page_nr").collect()
        assert b"".join(r.content for r in again) == src
    with pytest.raises(FormatError):
        archive.read_tables(spark, str(path / "t"), a)


def test_partition_of_classes(spark, files):
    path, _, src = files
    got = classify(read_pages(spark, str(path / "src"), PAGE), read_pages(spark, str(path / "ref"), PAGE), delta=PAGE, arrow=True)
    counts = {r.cls: r["count"] for r in got.groupBy("cls").count().collect()}
    assert sum(counts.values()) == -(-len(src) // PAGE) and set(counts) == {"SAME", "DEDUP", "DIFF", "NEW"}


def test_expressions_equal_numpy(spark, files):
    path, ref, src = files
    a, b = read_pages(spark, str(path / "src"), PAGE), read_pages(spark, str(path / "ref"), PAGE).withColumnRenamed("content", "old")
    rows = a.join(b, "page_nr").select(diff.patches("content", "old", PAGE).alias("x"), diff.patches_arrow("content", "old").alias("y")).collect()
    assert all(r.x == r.y for r in rows) and any(r.x for r in rows)


def test_page_scan(spark, files):
    path, _, src = files
    pages = read_pages(spark, str(path / "src"), 100, split=1000)
    got = pages.orderBy("page_nr").collect()
    assert b"".join(r.content for r in got) == src and [r.page_nr for r in got] == list(range(-(-len(src) // 100)))
    assert size(pages) == len(src)
    assert read_pages(spark, str(path / "src"), 100, full_only=True).count() == len(src) // 100


def test_targets(spark, files):
    path, _, src = files
    pages = read_pages(spark, str(path / "src"), PAGE)
    (path / "there").write_bytes(b"x")
    with pytest.raises(FileExistsError):
        write_pages(pages, str(path / "there"))
    write_pages(pages, str(path / "there"), "overwrite")
    assert (path / "there").read_bytes() == src
    with pytest.raises(FormatError):
        archive.compress(spark, str(path / "ref"), str(path / "src"), str(path / "z"), 8192, delta=True)
    with pytest.raises(FormatError):
        archive.compress(spark, str(path / "ref"), str(path / "src"), str(path / "z"), PAGE, inner="zip")


def test_intervalize_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 3)
    keys = "aabbbbbbbbbabaaaaaaa"
    pages = spark.createDataFrame([(k, c) for k, c in enumerate(keys) if k != 15], "page_nr long, key string")
    got = sorted((r["left"], r["right"], r.key) for r in intervals.intervalize(pages, "key").collect())
    assert got == [(0, 1, "a"), (2, 10, "b"), (11, 11, "a"), (12, 12, "b"), (13, 14, "a"), (16, 19, "a")]


def test_registry(spark, files):
    path, ref, src = files
    r = Registry(spark, 2)
    r.add_reference(str(path / "ref"), PAGE)
    assert r.reference(str(path / "ref"), PAGE) is r.reference(str(path / "ref"), PAGE)
    assert r.reference(str(path / "ref"), 256) is not r.reference(str(path / "ref"), PAGE)
    r.del_reference("nothing")
    r.compress(str(path / "ref"), str(path / "src"), str(path / "out"), PAGE, delta=True).result()
    r.decompress(str(path / "out"), str(path / "again")).result()
    assert (path / "again").read_bytes() == src
    with pytest.raises(Exception):
        r.compress(str(path / "none"), str(path / "src"), str(path / "x"), PAGE).result()
    r.close()
    assert r.references() == []


def test_arrivals(spark, files):
    from pagefold.streaming.arrivals import arriving_pages, classify_arrivals

    path, ref, src = files
    (path / "in").mkdir()
    (path / "in" / "a").write_bytes(src)
    pages = arriving_pages(spark, str(path / "in"), PAGE)
    q = classify_arrivals(pages, read_pages(spark, str(path / "ref"), PAGE), str(path / "out"), str(path / "cp"), PAGE)
    q.processAllAvailable()
    q.stop()
    want = classify(read_pages(spark, str(path / "src"), PAGE), read_pages(spark, str(path / "ref"), PAGE), delta=PAGE, arrow=True)
    key = lambda df: sorted((r.page_nr, r.cls) for r in df.collect())
    assert key(spark.read.parquet(str(path / "out"))) == key(want)


def test_command_line(spark, files):
    from pagefold.__main__ import main

    path, ref, src = files
    p = lambda name: str(path / name)
    assert main(["compress", p("ref"), p("src"), p("a"), "--pagesize", "512", "--delta", "--inner", "gzip"], spark) == 0
    assert main(["decompress", p("a"), p("b")], spark) == 0 and (path / "b").read_bytes() == src
    assert main(["decompress", p("a"), p("b")], spark) == 1 and main(["decompress", p("a"), p("b"), "--overwrite"], spark) == 0
    assert main(["intra", p("src"), p("c"), "--pagesize", "512"], spark) == 0 and small.unpack((path / "c").read_bytes()) == src
    assert main(["whole", p("src"), p("d"), "--inner", "7zip"], spark) == 0 and small.unpack((path / "d").read_bytes()) == src
    assert main(["decompress", p("src"), p("e")], spark) == 1 and main(["intra", p("none"), p("f")], spark) == 1


def test_signature_in_binary_pages(spark, files):
    from pagefold.operators.search import signature_scan

    path, _, src = files
    got = signature_scan(read_pages(spark, str(path / "src"), PAGE), F.lit(bytearray(src[1000:1010])))
    assert sorted(r.page_nr for r in got.collect()) == [1, 40]


def test_pages_are_written_by_many_tasks(spark, tmp_path):
    """Any order and partitioning, a short tail, none at all; gaps and short inner pages are refused."""
    rows = [(k, bytes([k % 251]) * 16) for k in range(500)] + [(500, b"tail")]
    pages = spark.createDataFrame(rows, "page_nr long, content binary").repartition(7)
    target = str(tmp_path / "many")
    write_pages(pages, target)
    assert open(target, "rb").read() == b"".join(c for _, c in rows)
    assert sorted((r.page_nr, bytes(r.content)) for r in read_pages(spark, target, 16, split=64).collect()) == rows
    write_pages(pages.limit(0), target, "overwrite")
    assert open(target, "rb").read() == b""
    for bad in (pages.filter("page_nr <> 3"), pages.filter("page_nr < 500").union(pages.filter("page_nr = 500").selectExpr("500L", "content")).union(spark.createDataFrame([(501, b"x" * 16)], pages.schema))):
        with pytest.raises(ValueError):
            write_pages(bad, target, "overwrite")


def test_requests_are_tried_again_and_references_expire(spark, tmp_path):
    path = tmp_path
    (path / "r").write_bytes(b"ab" * 100)
    r, calls = Registry(spark, 1, attempts=3, pause=0.0), []

    def flaky(error, times):
        def work():
            calls.append(1)
            if len(calls) < times:
                raise error
            return "done"

        return work

    assert r._submit(flaky(OSError("lost"), 3)).result() == "done" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        r._submit(flaky(OSError("lost"), 9)).result()
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(FileExistsError):
        r._submit(flaky(FileExistsError("there"), 9)).result()
    assert len(calls) == 1
    r.add_reference(str(path / "r"), 16)
    assert r.expire(1000) == [] and r.expire(0) == [(str(path / "r"), 16)] and r.references() == []
    assert r.reference(str(path / "r"), 16).count() == 13
    r.close()


def test_two_level_ranks_across_blocks(spark, monkeypatch):
    from pagefold.operators import intervals

    monkeypatch.setattr(intervals, "BLOCK", 4)
    rows = [(d, n) for d in (1, 2) for n in (0, 1, 5, 6, 7, 30, 31, 90)]
    df = spark.createDataFrame(rows, "dump_id long, page_nr long").repartition(3)
    both = intervals.running(intervals.previous(df, "before", ("dump_id",)), F.lit(1), "k", ("dump_id",)).collect()
    want = [(d, n, k + 1, None if k == 0 else [0, 1, 5, 6, 7, 30, 31, 90][k - 1]) for d in (1, 2) for k, n in enumerate((0, 1, 5, 6, 7, 30, 31, 90))]
    assert sorted((r.dump_id, r.page_nr, r.k, r.before) for r in both) == want
