"""Substring deduplication by Rabin-Karp window hashes.

Every window of ``width`` consecutive words is hashed with a rolling 64-bit
Rabin-Karp hash.  A window is repeated if its hash also starts in a document
with a smaller ``doc_id``; repeated windows of a document merge into maximal
intervals of words, which are removed.  Windows are judged on the input.

A block of documents settles its inner repeats by itself and sends each
distinct hash once; hash buckets find the first block that has it and answer
with one bit.  A passage found in a third of all documents therefore costs a
bucket one entry for each block.  Two unequal windows take part in a clash
with a chance of about 2^-60 a pair.

Defined results: a null, empty or short text has no window and loses nothing;
rows that repeat a ``doc_id`` are not earlier than each other, in whatever
blocks they are; a row without
``doc_id`` is kept whole and is no source of repeats; an empty table gives an
empty result; other columns are passed through or ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SUB, answer, ask, blocks, buckets_for, finish, hashed, in_batches, ordered, planes, shielded, split_buckets, table, texts, unplanes, windows, words

WIDTH = 50
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Windows:
    """The windows of a block, documents in ascending order of doc_id."""

    def __init__(self, part: pa.Table, width: int):
        ids = np.array(part.column("doc_id").to_pylist(), dtype=np.int64)
        self.order = np.argsort(ids, kind="stable")
        raw = texts(part.column("text"))
        values, counts = hashed([raw[k] for k in self.order])
        self.lengths = np.empty(len(ids), np.int64)
        self.lengths[self.order] = counts
        self.h, self.counts = windows(values, counts, width)
        rank = np.cumsum(np.diff(ids[self.order], prepend=ids[self.order][:1]) != 0)
        owner = np.repeat(rank.astype(np.int32), self.counts)
        self.sorted = np.argsort(self.h, kind="stable")
        s = self.h[self.sorted]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        self.run = np.cumsum(first) - 1
        self.u = s[first]
        so = owner[self.sorted]
        self.inner = so > so[first][self.run] if len(s) else np.empty(0, bool)

    def covered(self, earlier: np.ndarray, width: int) -> dict[int, np.ndarray]:
        """row -> mask of removed words, for rows that lose any; ``earlier``: a bit for each of ``u``."""
        hit = np.empty(len(self.h), bool)
        hit[self.sorted] = self.inner | earlier[self.run] if len(self.h) else self.inner
        out, at = {}, 0
        for k, n in zip(self.order.tolist(), self.counts.tolist()):
            mine = hit[at : at + n]
            at += n
            if mine.any():
                steps = np.zeros(self.lengths[k] + 1, np.int32)
                steps[:n] += mine
                steps[width : width + n] -= mine
                out[k] = np.cumsum(steps[:-1]) > 0
        return out


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [from, to) runs of a mask."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def without(text: bytes, mask: np.ndarray) -> bytes:
    """``text`` less the masked words and the white space before each; the rest of its layout stays."""
    out, at, end = [], 0, len(text)
    spans = [m.span() for m in _WORD.finditer(text)]
    for first, last in intervals(mask):
        start = spans[first - 1][1] if first else 0
        out.append(text[at:start])
        at = spans[last - 1][1] if last < len(spans) else end
    out.append(text[at:])
    return b"".join(out).lstrip(b" \t\n\v\f\r") if len(mask) and mask[0] else b"".join(out)


def _bits(bucket: int, rows: list[dict]) -> list[tuple]:
    rows.sort(key=lambda r: r["__g"])  # blocks in the order of doc_id, so that a key's first place is its earliest
    keys = [unplanes(r["keys"]) for r in rows]
    place = np.unique([r["__g"] >> SUB for r in rows], return_inverse=True)[1].astype(np.int32)
    order, _, new = ordered(np.concatenate(keys))
    at = np.repeat(place, [len(k) for k in keys])[order]
    later = np.empty(len(order), bool)
    later[order] = at > at[new][np.cumsum(new, dtype=np.int32) - 1]
    ends = np.cumsum([len(k) for k in keys])
    return [(r["__g"], bucket, "bits", np.packbits(later[e - len(k) : e]).tobytes()) for r, k, e in zip(rows, keys, ends)]


def _repeats(docs: DataFrame, columns: list[str], width: int, work, schema: str) -> DataFrame:
    """``work(table, windows, {row: mask})`` for each block of the documents that have a doc_id."""
    blocked, total = blocks(docs.filter("doc_id IS NOT NULL"), columns)
    n_buckets = buckets_for(total // 6)

    def emit(g, part):
        u = Windows(part, width).u
        return [(b, g, "win", planes(u[i:j]), None) for b, i, j in split_buckets(u, n_buckets)]

    def done(part, by):
        w = Windows(part, width)
        earlier = np.zeros(len(w.u), bool)
        for b, i, j in split_buckets(w.u, n_buckets):
            earlier[i:j] = np.unpackbits(np.frombuffer(by["bits", b], np.uint8), count=j - i)
        return work(part, w, w.covered(earlier, width))

    return finish(blocked, answer(ask(blocked, emit), _bits), done, schema)


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs``; ``text`` without its repeated windows."""

    def work(part, w, masks):
        raw = part.column("text").to_pylist()
        for k, mask in masks.items():
            raw[k] = without(raw[k].encode(), mask).decode()
        at = part.schema.get_field_index("text")
        return part.set_column(at, part.schema.field(at), pa.array(raw, part.schema.field(at).type)).drop_columns(["__g"])

    return shielded(docs, lambda d: _repeats(d, d.columns, width, work, d.schema).unionByName(d.filter("doc_id IS NULL")))


def removal_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), spans (array of removed [from, to) word intervals)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def rows(ids, raw, lengths, masks):
        digest, removed, spans = [], [], []
        for k, text in enumerate(raw):
            ws, mask = words(text), masks.get(k)
            if mask is not None:
                ws = [x for x, gone in zip(ws, mask.tolist()) if not gone]
            digest.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            removed.append(int(lengths[k] - len(ws)))
            spans.append([{"first": a, "last": b} for a, b in intervals(mask)] if mask is not None else [])
        return pa.table({"doc_id": ids, "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, span)})

    def work(part, w, masks):
        return rows(part.column("doc_id").cast(pa.int64()), texts(part.column("text")), w.lengths, masks)

    def whole(batches):
        for batch in batches:
            raw = texts(batch.column(1))
            yield from rows(batch.column(0), raw, [len(words(t)) for t in raw], {}).to_batches()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _repeats(docs, ["doc_id", "text"], width, work, schema).unionByName(in_batches(docs.filter("doc_id IS NULL"), whole, schema))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), hashed AS (
  SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda p: md5(array_to_string(ws[p:p + 49], ' '))) AS hs FROM w
), win AS (
  SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM hashed
), mins AS (
  SELECT h, min(doc_id) AS m FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN mins USING (h) WHERE m < doc_id
), each AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
