"""Benchmark decontamination with an FM-index per training shard.

A window is ``width`` consecutive words of a benchmark item (a shorter item is
one window).  The distinct windows are the phrases searched.  Each task turns
its shard of the documents into word numbers, indexes them with an FM-index
(suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix
for ranks, sampled suffix positions) and runs all phrases through backward
search at once; occurrences are located, and their spans merged per document.

Words that no phrase uses cannot be inside an occurrence, so a shard keeps only
runs of phrase words that are long enough to hold the shortest phrase.  This
loses nothing and keeps the index small; documents are cut nowhere else.

The phrases go to the tasks in parts of about ``part_words`` words, so what
is sent has a fixed bound; a larger benchmark takes several passes.  All but the
last write the spans of the documents they hit and nothing else; these are
united with the last one's.

Defined results: null or empty texts have no words, and no item; an item that
is null or has no words has no window; the windows of an item without item_id
hit words, but it is neither counted nor listed; repeated items with one item_id
count once; rows that repeat a ``doc_id`` are judged one by one; an empty
benchmark hits nothing; an empty table gives an empty result; other columns are
ignored or, by ``drop_contaminated`` and ``cut_passages``, passed through,
whatever their names.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, plain_words, settle, shielded, table, texts

WIDTH, PART_WORDS, SAMPLE, SHARD_WORDS = 13, 500_000, 8, 1 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t`` by prefix doubling; the end sorts before all."""
    n, step = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        if new[order[-1]] == n or step >= n:
            return order
        rank, step = new, step * 2


class Wavelet:
    """Wavelet matrix: ranks of many symbols at many places at once."""

    def __init__(self, s: np.ndarray, bits: int):
        self.zeros, self.ones, self.bits = [], [], bits
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        low, high = np.zeros_like(at), at.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one, bit = self.ones[level], (symbol >> b) & 1 == 1
            a, z = one[low], one[high]
            low = np.where(bit, self.zeros[level] + a, low - a)
            high = np.where(bit, self.zeros[level] + z, high - z)
        return high - low


class FMIndex:
    """An index of a sequence of positive numbers below ``top``; 0 is its end."""

    def __init__(self, t: np.ndarray, top: int, sample: int = SAMPLE):
        t = np.append(t, 0)
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.wavelet = Wavelet(self.bwt, max(1, int(top).bit_length()))
        self.less = np.searchsorted(np.sort(t), np.arange(top + 1))
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (a matrix, left-justified) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero((k < lengths) & (low < high))
            c = phrases[at, k]
            low[at] = self.less[c] + self.wavelet.rank(c, low[at])
            high[at] = self.less[c] + self.wavelet.rank(c, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.less[c] + self.wavelet.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.samples[self.mark_rank[rows]] + steps


class Phrases:
    """The distinct windows of some items, as numbers of their words."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number, rows, owners = {x: k for k, x in enumerate(self.names)}, [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item_id, text in items:
            ws = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in plain_words(text)], np.int32)
            if len(ws):
                rows.append(np.lib.stride_tricks.sliding_window_view(np.pad(ws, (0, max(0, width - len(ws)))), width))
                owners.append(np.full(len(rows[-1]), number[str(item_id)] if item_id is not None else -1))
        matrix, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.matrix, self.lengths = matrix.astype(np.int64), (matrix > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(matrix) else 0
        self.top = len(self.vocabulary) + 2
        # the items of each phrase, one after another
        both = np.unique(np.stack((which.ravel(), np.concatenate(owners)), axis=1), axis=0)
        both = both[both[:, 1] >= 0]
        self.items, self.ends = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(matrix) + 1))

    def find(self, shard: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(document, from, to) of the shard's merged spans of words, and (document, item), both in order; 1 separates the runs that are indexed."""
        number, spans, items = self.vocabulary.get, np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
        lengths = np.array([len(ws) for ws in shard], np.int64)
        t = np.fromiter((number(w, 0) for w in chain.from_iterable(shard)), np.int64, int(lengths.sum()))
        if not len(t) or not self.shortest:
            return spans, items
        first = np.cumsum(lengths) - lengths
        known = t > 0
        edge = np.ones(len(t) + 1, bool)
        edge[1:-1] = known[1:] != known[:-1]
        edge[first[lengths > 0]] = True
        at = np.flatnonzero(edge)
        start, size = at[:-1], np.diff(at)
        good = known[start] & (size >= self.shortest)
        start, size = start[good], size[good]
        if not len(start):
            return spans, items
        # runs one after the other, each followed by a separator
        moved = np.cumsum(size + 1) - size - 1
        source = np.repeat(start - moved, size + 1) + np.arange(int((size + 1).sum()))
        text = np.ones(len(source), np.int64)
        inside = np.ones(len(source), bool)
        inside[moved + size] = False
        text[inside] = t[source[inside]]
        index = FMIndex(text, self.top)
        low, high = index.search(self.matrix, self.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        if not len(phrase):
            return spans, items
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(phrase))
        place = source[index.locate(rows)]
        doc = np.searchsorted(first, place, side="right") - 1
        pairs = np.unique(doc * len(n) + phrase)  # each phrase once a document, however often it occurs
        d, p = np.divmod(pairs, len(n))
        many = self.ends[p + 1] - self.ends[p]
        at = np.repeat(self.ends[p] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        items = np.unique(np.stack((np.repeat(d, many), self.items[at]), axis=1), axis=0)
        order = np.lexsort((place, doc))
        start, end, doc = place[order], (place + self.lengths[phrase])[order], doc[order]
        upto = np.maximum.accumulate(end)
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > upto[:-1]) | (doc[1:] != doc[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
        spans = np.stack((doc[new], start[new] - first[doc[new]], upto[last] - first[doc[new]]), axis=1)
        return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of [from, to) spans, as maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "__spans array<struct<a:long,b:long>>, __items array<string>"


def _typed(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _pass(docs: DataFrame, phrases: Phrases, hits_only: bool = False) -> DataFrame:
    """``docs``, or those with a hit, with n_words, merged spans and items."""
    names = docs.columns

    def lists(keys: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(n + 1)), pa.int32()), values)

    def flush(rows, shard):
        spans, items = phrases.find(shard)
        pair = pa.StructArray.from_arrays([pa.array(spans[:, 1], pa.int64()), pa.array(spans[:, 2], pa.int64())], ["a", "b"])
        cols = [pa.array([len(ws) for ws in shard], pa.int64()), lists(spans[:, 0], len(shard), pair), lists(items[:, 0], len(shard), pa.array(phrases.names, pa.string()).take(pa.array(items[:, 1])))]
        done = pa.Table.from_batches(rows)
        for name, col in zip(("n_words", "spans", "items"), cols):
            done = done.append_column(f"__{name}", col)
        if hits_only:
            done = done.take(pa.array(np.unique(spans[:, 0]))).drop_columns(["text"])
        return done.combine_chunks().to_batches()

    def run(batches):
        rows, shard, held = [], [], 0
        for batch in batches:
            done = 0
            for k, text in enumerate(texts(batch.column(names.index("text")))):
                shard.append(plain_words(text))
                held += len(shard[-1])
                if held >= SHARD_WORDS:
                    yield from flush([*rows, batch.slice(done, k + 1 - done)], shard)
                    rows, shard, held, done = [], [], 0, k + 1
            if done < batch.num_rows:
                rows.append(batch.slice(done))
        if rows:
            yield from flush(rows, shard)

    return in_batches(docs, run, f"{_typed(docs.drop('text').schema if hits_only else docs.schema)}, __n_words long, {_FOUND}")


def phrase_parts(benchmark: DataFrame, width: int, part_words: int):
    """The items in parts of about ``part_words`` words; one part at a time is on the driver."""
    part, held = [], 0
    for row in benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if row.text is None:
            continue
        part.append((row.item_id, row.text.encode()))
        held += len(row.text) // 4
        if held >= part_words:
            yield Phrases(part, width)
            part, held = [], 0
    yield Phrases(part, width)


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with __n_words, __spans (maximal hit spans of words) and __items (ids of items found), names that ``docs`` does not have."""
    key = [F.xxhash64("doc_id", "text").alias("__k1"), F.xxhash64("text", "doc_id").alias("__k2")]  # rows with equal keys have equal hits
    parts, earlier = phrase_parts(benchmark, width, part_words), []
    phrases = next(parts)
    for later in parts:
        hits = _pass(docs.select(*key, F.col("text").cast("string").alias("text")), phrases, True)
        earlier.append(settle(hits.dropDuplicates(["__k1", "__k2"])))
        phrases = later
    if not earlier:
        return _pass(docs, phrases)
    hits = earlier[0]
    for more in earlier[1:]:
        hits = hits.union(more)
    hits = hits.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("__spans")).alias("__s"), F.flatten(F.collect_list("__items")).alias("__i"))  # one row a part
    found = _pass(docs, phrases).select("*", *key).join(hits, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return _united(found)


def _united(found: DataFrame) -> DataFrame:
    """__s and __i of other parts merged into __spans and __items."""
    names = [c for c in found.columns if c not in ("__s", "__i", "__spans", "__items")]
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans, s, items, i = (batch.column(c).to_pylist() for c in ("__spans", "__s", "__items", "__i"))
            for k in range(len(s)):
                if s[k] is not None:
                    spans[k] = [{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in spans[k] + s[k]])]
                    items[k] = sorted({*items[k], *i[k]})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], [*names, "__spans", "__items"])

    return in_batches(found, run, f"{_typed(found.select(*names).schema)}, {_FOUND}")


def judged(found: DataFrame) -> DataFrame:
    """n_hit and contaminated added: at least one word in twenty inside an occurrence."""
    found = found.withColumn("n_hit", F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]))
    return found.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= __n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; the rest as they are."""
    return shielded(docs, lambda d: judged(find_passages(d, benchmark)).filter("NOT contaminated"))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")  # as ``plain_words``


def cut(text: str | None, first: list[int], last: list[int]) -> str | None:
    """``text`` without the words of some merged spans and what is between them."""
    if not text or not len(first):
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in zip(first, last):
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def cut_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the merged benchmark spans cut out of all texts; other columns are as they are."""

    @F.pandas_udf("string")
    def shorter(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([cut(*x) for x in zip(text, first, last)], dtype=object)

    return shielded(docs, lambda d: find_passages(d, benchmark).withColumn("text", shorter(F.col("text").cast("string"), F.col("__spans")["a"], F.col("__spans")["b"])))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = judged(find_passages(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), "n_hit", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op9_decontamination": op9_decontamination}

ORACLES = {
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(1, greatest(len(ws) - 13, 0) + 2), lambda p: array_to_string(ws[p:p + 12], ' '))) AS w FROM b WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT n FROM g
), t AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p:p + n - 1], ' '))) AS w
  FROM d, sizes WHERE len(ws) >= n
), hit AS (
  SELECT doc_id, t.n, p, item_id FROM t JOIN g ON t.w = g.w AND t.n = g.n
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(i) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
}
