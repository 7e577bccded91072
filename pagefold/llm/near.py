"""Near-duplicate groups by MinHash and odd sketches.

A document's set is its distinct five-word shingles as 64-bit hashes.  192
MinHash samples give band keys and are folded into an odd sketch: a 1024-bit map
in which each sample flips one bit, so that the population count of the XOR of
two maps estimates their similarity, most precisely where it is high.  The
samples of a band are as many as keep the chance that two sets at the threshold
share no band below 3e-7: 32 bands of six at 85 %, 38 of five at 80 %.

1. Documents with equal sets become one class, represented by its smallest doc_id.
2. Inside each band the sketches are compared and a spanning set of likely
   links is kept; the likely links' components hold every true link.
3. Inside each such component links are confirmed on the full sets.

Both steps search breadth first: a visited member is compared with the members
not reached so far, so a dense group of m costs about m comparisons, never m^2
links.  A band or component beyond ``CAP_ROWS`` or ``CAP_BYTES`` is dealt out
over several tasks that share a few pivots; members that are not joined to the
group's largest part after that are compared with every block of it, so no link
is lost and no task holds an unbounded group.  Links are contracted to stars
inside each task before they are joined across tasks.

Defined results: with one to four words the whole sequence is the one shingle;
null, empty or blank texts have no shingle and are linked with nothing; repeated
rows are returned as often as they are given, and rows of one ``doc_id`` with
different texts are judged one by one; a null ``doc_id`` gets a null component
and is kept; an empty table gives an empty result; other columns are ignored or,
by ``keep_first``, passed through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, free, hashed, in_batches, mix, rolling, settle, table, texts, windows

WIDTH, SAMPLES, BITS = 5, 192, 1024
#: Percent from which two sets are linked, 100 * intersection >= percent * union: of the digest query, and of ``keep_first``.
PERCENT, STAGE_PERCENT = 85, 80
MISS = 3e-7
ROWS_A_TASK, LINKS_AT_ONCE = 200_000, 1 << 20
CAP_ROWS, CAP_BYTES, PIVOTS = 1000, 48 << 20, 32

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FACTOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def shingles(raw: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    values, counts = hashed(raw, fold=True)
    h, n = windows(values, counts, width)
    end, last = np.cumsum(n), np.cumsum(counts)
    out = []
    for k in range(len(raw)):
        if 0 < counts[k] < width:  # the whole sequence is the one shingle
            out.append(rolling(values[last[k] - counts[k] : last[k]], int(counts[k])) ^ U64(int(counts[k])))
        else:
            out.append(np.unique(h[end[k] - n[k] : end[k]]))
    return out


def class_id(s: np.ndarray) -> int:
    """The hash of a whole set, as a signed number."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SAMPLES) minima; no set is empty."""
    flat = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((flat ^ _FLIP[j]) * _FACTOR[j], at)
    return out


def band_rows(percent: int) -> int:
    """The most samples a band may have so that two sets at the threshold share one but for a chance of MISS."""
    return max(r for r in range(1, SAMPLES) if r == 1 or (1 - (percent / 100) ** r) ** (SAMPLES // r) < MISS)


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    bands = SAMPLES // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(samples), bands)).copy()
    for r in range(rows):
        key = mix(key + samples[:, r : bands * rows : rows].astype(U64) * U64(0x9E3779B97F4A7C15))
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(len(samples), BITS / 64) words; bit p is the parity of the samples that fall on p."""
    pos = mix(samples.astype(U64) | (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(BITS)
    cell = pos.astype(np.int64) + np.arange(len(samples), dtype=np.int64)[:, None] * BITS
    odd = np.bincount(cell.ravel(), minlength=len(samples) * BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(U64).reshape(len(samples), BITS // 64)


def most_bits(percent: int, sigmas: float = 6.0) -> int:
    """XOR population count that a pair of this similarity exceeds with the chance of ``sigmas`` deviations only."""
    similarity = percent / 100
    mean, sd = 2 * SAMPLES * (1 - similarity), 2 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    flips = mean + sigmas * math.hypot(sd, math.sqrt(mean / 4))
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** flips))


MOST = most_bits(PERCENT)


def _text_hash(docs: DataFrame) -> F.Column:
    return F.xxhash64(docs["text"].cast("string"))


def features(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls (hash of the set), bands, sketch of each document that has a doc_id."""
    schema, names = "doc_id long, text_hash long, n_shingles long, cls long, bands array<long>, sketch binary", ["doc_id", "text_hash", "n_shingles", "cls", "bands", "sketch"]
    wide = band_rows(percent)

    def rows(ids, sets):
        full = [s for s in sets if len(s)]
        samples = minhash(full) if full else np.empty((0, SAMPLES), np.uint32)
        keys, sketches = iter(band_keys(samples, wide).view(np.int64).tolist()), iter(odd_sketch(samples) if full else ())
        cols = [*zip(*ids), [len(s) for s in sets], [class_id(s) for s in sets], [next(keys) if len(s) else [] for s in sets], [next(sketches).tobytes() if len(s) else b"" for s in sets]]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        for batch in batches:
            ids, part, held = [], [], 0
            for *both, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                ids.append(both)
                part.append(text)
                held += len(text or b"")
                if held >= 1 << 18:  # stays in the cache
                    yield rows(ids, shingles(part))
                    ids, part, held = [], [], 0
            if ids:
                yield rows(ids, shingles(part))

    return in_batches(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), _text_hash(docs), F.col("text").cast("string")), run, schema)


class Members:
    """Rows of a task: ids, sketches and, for the exact step, full sets."""

    def __init__(self, part: pa.Table, sets: list[np.ndarray] | None, percent: int):
        self.percent, self.most = percent, most_bits(percent)
        self.id = part.column("id").to_numpy()
        raw = part.column("sketch").to_pylist()
        self.sketch = np.frombuffer(b"".join(raw), U64).reshape(len(raw), BITS // 64)
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64) if sets is not None else None

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Mask of ``others`` that are linked with x: likely by the sketches, surely where there are sets."""
        found = np.bitwise_count(self.sketch[others] ^ self.sketch[x]).sum(axis=1) <= self.most
        if self.sets is None:
            return found
        small, large = np.minimum(self.size[others], self.size[x]), np.maximum(self.size[others], self.size[x])
        at = np.flatnonzero(found & (100 * small >= self.percent * large))
        found[:] = False
        for k in range(0, len(at), 2000):
            part = at[k : k + 2000]
            lengths = self.size[others[part]]
            flat = np.concatenate([self.sets[y] for y in others[part]])
            mine = self.sets[x]
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64)
            found[part] = 100 * both >= self.percent * (len(mine) + lengths - both)
        return found

    def span(self, rest: np.ndarray) -> list[tuple[int, int]]:
        """A spanning set of the links between these rows, by breadth-first search."""
        links = []
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            todo = [root]
            while todo and len(rest):
                hit = self.near(todo.pop(), rest)
                found, rest = rest[hit], rest[~hit]
                todo += found.tolist()
                links += [(int(self.id[root]), int(self.id[y])) for y in found]
        return links


LINKS = "a long, b long"


def _links(pairs) -> pa.Table:
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _members(part: pa.Table, columns: list[str], exact: bool, percent: int):
    """The rows sorted by ``columns`` and id, as Members, and the bounds of their groups.

    For the exact step sets are made of the texts; where a doc_id came with several texts, only the
    one that made the class is taken.
    """
    sets = []
    if exact:
        raw = shingles(texts(part.column("text")))
        good = np.array([class_id(s) for s in raw]) == part.column("id").to_numpy()
        part = part.append_column("row", pa.array(np.arange(len(raw)))).filter(pa.array(good)).drop_columns(["text"])
        sets = raw
    part = part.sort_by([(c, "ascending") for c in [*columns, "id"]])
    change = np.zeros(part.num_rows, bool)
    for c in columns:
        v = part.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    change[:1] = True
    m = Members(part, [sets[k] for k in part.column("row").to_pylist()] if exact else None, percent)
    return part, m, np.append(np.flatnonzero(change), part.num_rows)


def _within(exact: bool, percent: int):
    def run(key, part):
        _, m, at = _members(part, ["key", "salt"], exact, percent)
        links, lengths = [], np.diff(at)
        if not exact and len(lengths):  # all members against their group's first at once; most groups are done by this
            first = np.repeat(at[:-1], lengths)
            near = np.bitwise_count(m.sketch ^ m.sketch[first]).sum(axis=1) <= m.most
            done = np.logical_and.reduceat(near, at[:-1])
            rows = np.repeat(done, lengths)
            links = list(zip(m.id[first][rows].tolist(), m.id[rows].tolist()))
        for k in range(len(lengths)):
            if lengths[k] > 1 and (exact or not done[k]):
                links += m.span(np.arange(at[k], at[k + 1]))
        return _links(set(links))

    return run


def _across(exact: bool, percent: int):
    def run(key, part):
        part, m, at = _members(part, ["key", "salt", "chunk"], exact, percent)
        rest, label = part.column("rest").to_numpy(zero_copy_only=False), part.column("label").to_numpy()
        links = []
        for i, j in zip(at[:-1], at[1:]):
            block = np.arange(i, j)[~rest[i:j]]
            for x in np.arange(i, j)[rest[i:j]]:
                found = block[m.near(int(x), block)] if len(block) else block
                found = found[np.unique(label[found], return_index=True)[1]]
                links += [(int(m.id[x]), int(m.id[y])) for y in found]
        return _links(set(links))

    return run


def link(members: DataFrame, payload: DataFrame, exact: bool, percent: int, cap_rows: int | None = None, cap_bytes: int | None = None) -> DataFrame:
    """id, label: the smallest id of the component that the links inside all keys make, for every id that has a link.

    ``members``: key, id, bytes; ``payload``: id, sketch and, if ``exact``, text.  In the exact step the
    keys are disjoint.
    """
    cap_rows, cap_bytes = cap_rows or CAP_ROWS, cap_bytes or CAP_BYTES
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("w")).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / cap_rows), F.ceil(F.col("w") / cap_bytes))
    dealt = members.join(sizes.select("key", parts.alias("parts")), "key").select("key", "id", "parts", "bytes", F.expr("pmod(xxhash64(id, 7L), parts)").alias("salt"))
    dealt, total, weight, most = settle(dealt, F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(0)))
    tasks = max(16, math.ceil(total / 20_000), math.ceil(weight / (16 << 20)))

    def spread(rows: DataFrame, columns: str, work) -> DataFrame:
        return rows.join(payload, "id").withColumn("task", F.expr(f"pmod(xxhash64({columns}), {tasks})")).groupBy("task").applyInArrow(work(exact, percent), LINKS).coalesce(tasks)

    cold = spread(dealt.filter("parts = 1"), "key, salt", _within)
    if most <= 1:
        return _stars(cold) if exact else components(cold)
    hot = dealt.filter("parts > 1")
    pivots = hot.groupBy("key", "parts", F.expr(f"pmod(xxhash64(id, 11L), {PIVOTS})").alias("p")).agg(F.min("id").alias("id")).select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    first = settle(_contracted(spread(hot.select("key", "id", "salt").union(pivots).distinct(), "key, salt", _within)))
    hot = hot.join(components(first), "id", "left").withColumn("label", F.coalesce("label", "id"))
    main = hot.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    hot, unjoined = settle(hot.join(main, "key").withColumn("rest", F.expr("label <> main")).drop("main"), F.count_if("rest"))
    found = first
    if unjoined:
        rest = hot.filter("rest")
        chunks = rest.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / cap_rows, F.sum("bytes") / cap_bytes)).alias("chunks"))
        nth = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asked = rest.join(chunks, "key").select("key", "id", nth("parts").alias("salt"), F.expr("pmod(xxhash64(id, 13L), chunks)").alias("chunk"), "rest", "label")
        block = hot.join(chunks, "key").select("key", "id", "salt", nth("chunks").alias("chunk"), F.lit(False).alias("rest"), "label")
        found = first.union(spread(asked.union(block), "key, salt, chunk", _across))
    return _stars(cold).union(components(found)) if exact else components(found.union(cold))


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links' components: (each vertex that is not the smallest of its own, that smallest)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    return ids[leaf], ids[root[leaf]]


def _contracted(links: DataFrame) -> DataFrame:
    """(a < b): the links of each task as stars, in bounded pieces."""

    def run(batches):
        held, n = [], 0

        def stars():
            b, a = contract(*map(np.concatenate, zip(*held)))
            return a, b

        def out():
            a, b = stars()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > LINKS_AT_ONCE:
                held = [stars()]
                n = len(held[0][0])
                if n > LINKS_AT_ONCE // 2:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return links.filter("a <> b").select("a", "b").mapInArrow(run, LINKS)


def _stars(links: DataFrame) -> DataFrame:
    """id, label of links whose components each lie in one task."""
    return _labels(_contracted(links).select(F.col("b").alias("v"), F.col("a").alias("u")))


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("v").alias("id"), F.col("u").alias("label")).union(stars.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct())


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of the component, for every id in a link.

    Each round finds every vertex's smallest neighbour below it, ties both ends of each edge to the
    smaller of their two, and contracts the outcome inside each task; the edges are done when they are
    stars, which the table of smallest neighbours tells.  Both are written, so that lineage is cut and
    the join sees two plain shuffles, in which Spark can split a hub's partition.
    """
    edges, n = settle(_contracted(links).select(F.col("b").alias("v"), F.col("a").alias("u")), F.count("*"))
    while True:
        tasks = max(8, -(-n // ROWS_A_TASK))
        # each task of the contraction gives a vertex one edge down, so no vertex has many; hubs are combined by distinct()
        ends = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.lit(None).cast("long").alias("u")).distinct())
        low = ends.groupBy("v").agg(F.min("u").alias("m"), F.max("u").alias("n"), F.count_if(F.col("u").isNull()).alias("above")).filter("m IS NOT NULL")
        low, open_ = settle(low.select("v", "m", F.expr("n > m OR above > 0").alias("open")).coalesce(tasks), F.count_if("open"))
        low = low.select("v", F.col("m").alias("u"))
        if not open_:
            return _labels(low)
        of_v, of_u = low.withColumnRenamed("u", "m"), low.select(F.col("v").alias("u"), F.col("u").alias("m2"))
        both = edges.join(of_v, "v").join(of_u, "u", "left")
        least = F.least("m", F.coalesce("m2", "u"))
        tied = F.array(*(F.struct(least.alias("a"), F.col(x).alias("b")) for x in ("v", "u", "m")))
        tied = both.select(F.explode(tied).alias("e")).select("e.a", "e.b").coalesce(tasks)
        edges, n = settle(_contracted(tied).select(F.col("b").alias("v"), F.col("a").alias("u")), F.count("*"))


def near_duplicates(docs: DataFrame, cap_rows: int | None = None, cap_bytes: int | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _judged(docs, percent, cap_rows, cap_bytes).drop("text_hash").union(_unnamed(docs))


def _judged(docs: DataFrame, percent: int, cap_rows: int | None = None, cap_bytes: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each document that has a doc_id."""
    marked = settle(features(docs, percent))
    some = marked.filter("n_shingles > 0")
    classes = settle(some.groupBy(F.col("cls").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    bands = classes.select(F.explode("bands").alias("key"), "id", F.lit(BITS // 8).alias("bytes"))
    likely = link(bands, classes.select("id", "sketch"), False, percent, cap_rows, cap_bytes)
    members = settle(likely.join(classes, "id").select(F.col("label").alias("key"), "id", "doc_id", "sketch", (8 * F.col("n")).alias("bytes")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = text.join(members.select("doc_id", "id", "sketch"), "doc_id").drop("doc_id")
    label = link(members.select("key", "id", "bytes"), full, True, percent, cap_rows, cap_bytes)
    labelled = classes.select("id", "doc_id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = labelled.groupBy("label").agg(F.min("doc_id").alias("c"))
    named = labelled.join(first, "label").select(F.col("id").alias("cls"), "c")
    own = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id")
    out = marked.select("doc_id", "text_hash", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "text_hash", "n_shingles", own)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _unnamed(docs: DataFrame) -> DataFrame:
    """Rows without doc_id."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingles(texts(batch.column(0)))], pa.int64())], ["n_shingles"])

    rows = in_batches(docs.filter("doc_id IS NULL").select(F.col("text").cast("string")), run, "n_shingles long")
    return rows.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))


def keep_first(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` without the rows whose text is not of the first document of its group."""
    d, h = free(docs, "id"), free(docs, "hash")
    gone = _judged(docs, percent).filter("NOT kept").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    return docs.withColumn(h, _text_hash(docs)).alias("x").join(gone.alias("y"), F.expr(f"x.doc_id = y.{d} AND x.{h} = y.{h}"), "left_anti").drop(h)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}

ORACLES = {
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), e AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x
), c AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(m, w.doc_id), w.doc_id) AS component_id,
       coalesce(least(m, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
""",
}
