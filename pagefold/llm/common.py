"""Shared parts of the training-data operators.

``blocks`` gives every document a block key; blocks are disjoint, ascending
ranges of ``doc_id`` of about equal numbers of bytes, ``hash_blocks`` the same
without an order.  One distributed pattern serves the corpus-wide operators:
every block sends packed arrays of 64-bit keys to hash buckets (``ask``), the
buckets aggregate them over the whole corpus and answer each block in the order
asked (``answer``), and the block finishes its own documents (``finish``).  A
key that a third of the rows share is sent once per block, never once per row,
so no bucket can grow hot.

Blocks and buckets grow with the corpus up to bounds that a worker's memory
sets, so that messages stay long; beyond these bounds the number of messages
grows with the square of the corpus, which still leaves some forty keys in a
message at a TB of text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import settle  # noqa: F401  (the operators take it from here)

RANGES, BATCH_ROWS, MOST_PARTS = 20_000, 1000, 2048
#: Bytes of a block and keys of a bucket, least and most.
BLOCK_BYTES, BUCKET_KEYS = (4 << 20, 32 << 20), (1 << 20, 1 << 21)
#: What a row weighs besides its text, and bits of a block key that tell parts of one doc_id apart.
ROW_BYTES, SUB = 64, 20
U64 = np.uint64

#: Bytes that are not part of a word for the two word rules (see ``words`` and ``plain_words``).
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_PLAIN = bytes(b if b in _KEEP else 0x20 for b in _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; None has none.  ``bytes.split`` splits on exactly those six bytes."""
    return text.split() if text else []


def lower(text: bytes | None) -> bytes:
    """A-Z in lower case, every other byte as it is."""
    return text.translate(_LOWER) if text else b""


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_PLAIN).split() if text else []


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the entropy of each key over all its bits."""
    x = x.astype(U64, order="C", copy=True)
    flat = x.reshape(-1)
    for k in range(0, len(flat), 1 << 14):  # in pieces that stay in a core's cache
        v = flat[k : k + (1 << 14)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            v ^= v >> U64(shift)
            if factor:
                v *= U64(factor)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1); up to a million are kept."""
    known = _kept_powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=U64)
        known[0] = 1
        known = np.cumprod(known, dtype=U64)
        if n <= 1 << 20:
            _kept_powers[base] = known
    return known[:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64 and then mixed, of each window of ``width`` values."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=U64)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * _powers(_BASE, n), dtype=U64, out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * _powers(_INVERSE, n - width + 1))


_INSIDE = bytes(b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256))
_BYTE = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=U64)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
HASHED_AT_ONCE, LONG_WORD = 1 << 16, 128


def _hash_buffer(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, and where each begins.

    A word's hash mixes its length and its bytes, eight at a time.  That of a word of more than
    ``LONG_WORD`` bytes is a polynomial of its bytes' table values instead, taken from running sums over
    the whole buffer.  Unequal words clash with a chance of about 2^-58 a pair.
    """
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = np.frombuffer(raw.translate(_INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray(len(a), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(U64) * U64(_BASE) ^ (eight[start] & _FIRST_BYTES[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        left = size[at] - k
        h[at] = mix(h[at] * U64(_BASE) ^ (eight[start[at] + k] & _FIRST_BYTES[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    if len(long := np.flatnonzero(size > LONG_WORD)):
        prefix = np.zeros(len(a) + 1, dtype=U64)
        np.cumsum(_BYTE[a] * _powers(_BASE, len(a)), dtype=U64, out=prefix[1:])
        h[long] = mix((prefix[end[long]] - prefix[start[long]]) * _powers(_INVERSE, len(a))[start[long]] + size[long].astype(U64) * U64(_BASE))
    return h, start


def hashed(raw: list[bytes | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all ``words`` of some texts, one text after another, and each text's number of words.

    ``fold``: of the lower-cased words.  Long texts are cut at white space, so the memory needed does
    not depend on their length.
    """
    out, counts, part, held = [], np.zeros(len(raw), np.int64), [], 0

    def flush():
        buffer = b"\n".join(x for _, x in part)
        h, start = _hash_buffer(lower(buffer) if fold else buffer)
        first = np.cumsum([0, *(len(x) + 1 for _, x in part)])
        np.add.at(counts, [k for k, _ in part], np.diff(np.searchsorted(start, first)))
        out.append(h)

    for k, text in enumerate(raw):
        at = 0
        while text and at < len(text):
            cut = _NEXT_SPACE.search(text, at + HASHED_AT_ONCE)
            end = cut.start() if cut else len(text)
            part.append((k, text[at:end]))
            held, at = held + end - at, end
            if held >= HASHED_AT_ONCE:
                flush()
                part, held = [], 0
    if part:
        flush()
    return np.concatenate(out) if out else np.empty(0, U64), counts


def windows(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows inside each text, one text after another, and each text's number of windows."""
    n = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return rolling(values, width)[at] if len(at) else np.empty(0, U64), n


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order that sorts the keys, the sorted keys, and where each distinct one begins among them.

    Keys are sorted by their leading bits with their place in the others, several times faster than
    ``argsort``; should keys differ in their last bits only and come out of order, they are sorted in full.
    """
    bits = U64(max(1, len(keys) - 1).bit_length())
    both = keys >> bits
    both <<= bits
    both |= np.arange(len(keys), dtype=U64)
    both.sort()
    both &= (U64(1) << bits) - U64(1)
    order = both.view(np.int64)
    s = keys[order]
    if (s[1:] < s[:-1]).any():
        order = np.argsort(keys, kind="stable")
        s = keys[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return order, s, new


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and where each key stands among them."""
    order, s, new = ordered(keys)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse


def flagged(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, even numbers, sorted, and how many places of each have a flag: one sort of both together."""
    both = keys | flags
    both.sort()
    s = both & ~U64(1)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    first = np.flatnonzero(new)
    both &= U64(1)
    return s[first], np.add.reduceat(both, first).astype(np.int64) if len(first) else np.empty(0, np.int64)


class Distinct:
    """The distinct keys of an array, sorted (``u``), and the way between them and the array's places.

    Values go back in one scatter of their own width, which costs less than an array of places (``distinct``).
    """

    def __init__(self, keys: np.ndarray):
        self.order, s, new = ordered(keys)
        self.first = np.flatnonzero(new)
        self.u, self.sizes = s[self.first], np.diff(np.append(self.first, len(s)))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many of each key's places are set in ``mask``."""
        return np.add.reduceat(mask[self.order], self.first, dtype=np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Each place's value, of one for each key."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.sizes)
        return out


def planes(u: np.ndarray) -> bytes:
    """Sorted 64-bit keys as eight byte planes: the shared leading bytes then compress away."""
    return u.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(U64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 on in full behind them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=n)
    return counts


def in_batches(docs: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS texts, so that long texts do not pile up in a worker.

    Lowers the session's setting for this, if it is larger.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs.mapInArrow(run, schema)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name


def shielded(docs: DataFrame, work, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``work(docs)`` in ``docs``' own columns; while it runs, all but ``keep`` have names that clash with nothing."""
    inner = docs.toDF(*(c if c in keep else f"c{k}" for k, c in enumerate(docs.columns)))
    return work(inner).select(*inner.columns).toDF(*docs.columns)


def _between(total: int, bounds: tuple[int, int]) -> int:
    return min(max(total // MOST_PARTS, bounds[0]), bounds[1])


def buckets_for(keys: int) -> int:
    """Hash buckets, a power of two, for so many keys."""
    n = 16
    while n * _between(keys, BUCKET_KEYS) < keys:
        n *= 2
    return n


def _weight() -> F.Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def hash_blocks(docs: DataFrame, bounds: tuple[int, int] = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with a block key ``__g`` by the hash of doc_id and text, and the bytes of all rows."""
    total = docs.agg(F.coalesce(F.sum(_weight()), F.lit(0))).first()[0]
    n = max(1, -(-total // _between(total, bounds)))
    return docs.withColumn("__g", F.expr(f"pmod(xxhash64(doc_id, text), {n})")), total


def blocks(docs: DataFrame, columns: list[str], size: int | None = None, ranges: int = RANGES) -> tuple[DataFrame, int]:
    """``docs`` with a key ``__g``, and the bytes of all rows that have a ``doc_id``.

    ``__g >> SUB`` ascends with ``doc_id``.  Sampled quantiles of ``doc_id`` make fine ranges, whose bytes
    are then counted; neighbours are joined to blocks of about ``size`` bytes, and a range of more is
    divided: evenly by id, or by a hash of the text where it is one doc_id, whose parts then share one
    place in the order.  Only the ranges, at most about twice ``ranges``, come to the driver.  A null
    doc_id gets a null key.
    """
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _weight().alias("w"))
    total = ids.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    size = size or _between(total, BLOCK_BYTES)
    parts = min(4 * -(-total // size), ranges)
    found = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if total > size else []
    cuts, times = np.unique(np.array(found, np.int64), return_counts=True)
    cuts = np.unique(np.concatenate((cuts, cuts[times > 1] + 1)))  # an id that fills several ranges is one by itself

    @F.pandas_udf("long")
    def nth(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(np.int64), side="right"))

    n = len(cuts) + 1
    base, low, width, subs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 1 << 62, np.int64), np.ones(n, np.int64)
    if n > 1:
        block, held = 0, 0
        for r, weight, least, most in sorted(ids.groupBy(nth("doc_id")).agg(F.sum("w"), F.min("doc_id"), F.max("doc_id")).collect()):
            if held and held + weight > size:
                block, held = block + 1, 0
            base[r], low[r], held = block, least, held + weight
            pieces = min(-(-weight // size), 1 << SUB)
            if pieces > 1:
                if least == most:
                    subs[r] = pieces
                    block, held = block + 1, 0
                else:
                    width[r] = max(1, -(-(most - least + 1) // pieces))
                    block, held = block + int((most - least) // width[r]) + 1, 0

    @F.pandas_udf("long")
    def place(x: pd.Series, h: pd.Series) -> pd.Series:
        v = x.to_numpy(np.int64)
        r = np.searchsorted(cuts, v, side="right")
        order = base[r] + (v - low[r]) // width[r]
        return pd.Series(order << SUB | h.to_numpy(np.int64) % subs[r])

    key = F.when(F.col("doc_id").isNotNull(), place(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")))
    return docs.select(*columns, key.alias("__g")), total


def split_buckets(u: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for sorted keys; a bucket holds one range of the 64-bit space."""
    of = (u >> U64(64 - (n_buckets.bit_length() - 1))).astype(np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[at].tolist(), at.tolist(), np.append(at[1:], len(u)).tolist()))


ASK = "__b int, __g long, kind string, keys binary, extra binary"
REPLY = "__g long, __b int, kind string, reply binary"


def ask_rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    types = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("__b", "__g", "kind", "keys", "extra"), cols, types)})


def reply_rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    types = (pa.int64(), pa.int32(), pa.string(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("__g", "__b", "kind", "reply"), cols, types)})


def ask(blocked: DataFrame, emit) -> DataFrame:
    """``emit(g, table)`` yields (bucket, g, kind, keys, extra) rows of one block."""

    def run(key, part):
        return ask_rows(emit(key[0].as_py(), part))

    return blocked.groupBy("__g").applyInArrow(run, ASK)


def answer(asked: DataFrame, resolve) -> DataFrame:
    """``resolve(bucket, rows)`` yields (g, bucket, kind, reply) rows for all that was sent to a bucket."""

    def run(key, part):
        return reply_rows(resolve(key[0].as_py(), part.to_pylist()))

    return asked.groupBy("__b").applyInArrow(run, REPLY)


def finish(blocked: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """``work(table, {(kind, bucket): reply})`` gives the result of one block."""

    def run(key, part, got):
        by = {(r["kind"], r["__b"]): r["reply"] for r in got.to_pylist()}
        return work(part, by)

    return blocked.groupBy("__g").cogroup(replies.groupBy("__g")).applyInArrow(run, schema)
