"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are a text's lower-cased words and one end.  The tree predicts a token
from the longest retained context of up to ``DEPTH`` words before it.  A context
is retained if it occurs ``LEAST`` times in the training texts and its
next-token distribution diverges from that of its suffix: over hashed classes
of next tokens, by ``GAIN`` nats beyond what chance would give (classes can only
hide divergence, so the test is on the safe side).  ``LEAST`` is a number of
times, not a share, so the tree grows with the corpus.  Retained contexts are
closed under suffixes.  Distributions are smoothed towards the suffix's, down to
the root, which is the base model.

All training documents are counted.  The tree is a table and never in one
place: blocks of documents ask hash buckets (see ``common``) four times.

1. For the words' counts, and for the contexts of one and two words that occur
   often enough, by 40 bits of their hashes, which may let some rarer ones
   through; a longer context can be frequent only if all its pairs of words are.
2. Those contexts' exact counts by class of next token go to the buckets, which
   make the table of candidates, one row a context; the divergence of each from
   its suffix is one join of that table with itself.
3. Which of its contexts are retained, and their totals.
4. The corpus's counts of (context, token) pairs of these.

Buckets answer in the order asked.  A word or pair that every document has is
sent once a block.  What a block learns about its places (where contexts may
occur often, where they are retained) it sends on to itself as bits, so that
later passes need not find and look up all contexts again; each pass therefore
takes a block's rows in one order.

Defined results: a null text is empty: only its end is scored; a null doc_id
counts as the empty string for the split; repeated rows are scored alike and
counted each (rows equal in doc_id and text share a block); an empty table gives
an empty result, one without training rows uniform predictions; other columns
are ignored.
"""

from __future__ import annotations

import gc
import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ASK, REPLY, U64, Distinct, answer, ask, ask_rows, buckets_for, distinct, finish, flagged, hash_blocks, hashed, mix, ordered, packed, planes, reply_rows, settle, split_buckets, table, texts, unpacked, unplanes

LEAST, DEPTH, GAIN, PRIOR, CLASSES = 8, 4, 24.0, 2000.0, 64
#: Stand for the hashes of the end and of what is before the first word.
END, START = U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)
#: Bytes of a block, least and most: a block takes about thirty times as much memory.
BLOCK_BYTES = (4 << 20, 8 << 20)
CANDIDATE, CANDIDATE_TYPES = ["context", "s", "total", "classes", "counts", "more"], [pa.int64()] * 3 + [pa.binary()] * 3
_ODD, _CONTEXT, _EVEN = U64(0x9E3779B97F4A7C15), U64((1 << 64) - CLASSES), ~U64(1)


def held_out(doc_id="doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


class Tokens:
    """All tokens of some texts, each with the hashes of its contexts of one to ``depth`` words."""

    def __init__(self, raw: list[bytes | None], depth: int = 2):
        words, counts = hashed(raw, fold=True)
        self.lengths = counts + 1
        self._depth = depth
        place = np.repeat((depth + 1) * np.arange(len(raw)) + depth, counts) + np.arange(len(words))
        self._all = np.full(len(words) + (depth + 1) * len(raw), START, U64)
        self._all[place] = words
        end = np.cumsum(counts + depth + 1) - 1
        self._all[end] = END
        inside = np.ones(len(self._all), bool)
        inside[(end - counts)[:, None] - np.arange(1, depth + 1)] = False
        self._at = np.flatnonzero(inside)
        self.token = self._all[self._at]
        self.first = np.cumsum(self.lengths) - self.lengths

    def contexts(self, upto: int | None = None) -> list[np.ndarray]:
        """Ids of the contexts of one word, two words and so on; the low bits are free for a class."""
        out, self._h = [], np.zeros(len(self.token), U64)
        for k in range(1, min(upto or self._depth, self._depth) + 1):
            self._h = mix(self._h * _ODD + self._all[self._at - k] + U64(k))
            out.append(self._h & _CONTEXT)
        return out

    def deeper(self, k: int, hit: np.ndarray) -> np.ndarray:
        """After ``contexts`` or ``deeper`` of k - 1: ids of the contexts of k words where ``hit`` is set, among those before."""
        at = np.flatnonzero(hit)
        h = np.zeros(len(self.token), U64)
        h[at] = mix(self._h[at] * _ODD + self._all[self._at[at] - k] + U64(k))
        self._h = h
        return h & _CONTEXT


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple:
    """The distinct keys of all, where each key stands among them, and their summed counts."""
    u, inverse = distinct(np.concatenate(keys))
    return u, inverse, np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.int64)


def _bits(by: dict, kind: str, u: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits that buckets answered for sorted keys."""
    out = np.zeros(len(u), bool)
    for b, i, j in split_buckets(u, n_buckets):
        out[i:j] = np.unpackbits(np.frombuffer(by[kind, b], np.uint8), count=j - i)
    return out


def _answered(by: dict, kind: str, u: np.ndarray, n_buckets: int) -> np.ndarray:
    """The counts that buckets answered for sorted keys."""
    out = np.zeros(len(u))
    for b, i, j in split_buckets(u, n_buckets):
        out[i:j] = unpacked(by[kind, b], j - i)
    return out


class Tree:
    """The retained contexts, a table (context, total), and the totals of the root."""

    def __init__(self, kept: DataFrame, tokens: int, distinct: int, least: int, depth: int):
        self.kept, self.tokens, self.distinct, self.least, self.depth = kept, tokens, distinct, least, depth

    @cached_property
    def contexts(self) -> np.ndarray:
        """Ids in order; collected, for trees of small corpora only."""
        return np.sort(np.array([r.context for r in self.kept.select("context").collect()], np.int64).view(U64))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray]:
        """Which ids are retained; as ``contexts`` for small trees only."""
        return (np.isin(ids, self.contexts),)


def _free(spark) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


class Blocks:
    """Blocks of documents (doc_id, text, held_out), with the contexts that occur often in those not held out."""

    def __init__(self, docs: DataFrame, least: int, depth: int):
        if not 0 < least < 256:
            raise ValueError("least is from 1 to 255")
        self.spark, self.least, self.depth = docs.sparkSession, least, depth
        self.blocked, total = hash_blocks(docs, BLOCK_BYTES)
        self.buckets = buckets_for(total // 4)  # about two keys a word of six bytes, half of them repeated in a block
        self.often = self._often()

    def _often(self) -> DataFrame:
        """Replies with a bit for each context of a block of one or two words, by the leading bits of its hash; and the words' statistics."""
        depth, least, n_buckets = self.depth, self.least, self.buckets

        def emit(g, part):
            t = Tokens(texts(part.column("text")), depth)
            learnt = _learnt(t, part)
            u, c = flagged(np.concatenate(t.contexts(2)), np.tile(learnt, min(2, depth)))
            c = np.minimum(c, least).astype(np.uint8)  # sums reach ``least`` as those of the full counts do
            out = [(b, g, "often", planes(u[i:j])[: 5 * (j - i)], np.packbits(c[i:j] == 1).tobytes() + c[i:j][c[i:j] != 1].tobytes()) for b, i, j in split_buckets(u, n_buckets)]
            words = Distinct(t.token)
            w, n = words.u, words.count(learnt)
            return out + [(b, g, "word", planes(w[i:j]), packed(n[i:j])) for b, i, j in split_buckets(w, n_buckets)]

        def counts(r):
            m = len(r["keys"]) // 5
            c = np.unpackbits(np.frombuffer(r["extra"], np.uint8, -(-m // 8)), count=m)
            c[c == 0] = np.frombuffer(r["extra"], np.uint8, offset=-(-m // 8))
            return c

        def resolve(bucket, asked):
            out = []
            if rows := [r for r in asked if r["kind"] == "often"]:
                keys = [unplanes(r["keys"] + bytes(len(r["keys"]) // 5 * 3)) for r in rows]
                u, inverse = distinct(np.concatenate(keys))
                c = np.bincount(inverse, np.concatenate([counts(r) for r in rows]), len(u)) >= least
                ends = np.cumsum([len(k) for k in keys])
                out = [(r["__g"], bucket, "often", np.packbits(c[inverse[e - len(k) : e]]).tobytes()) for r, k, e in zip(rows, keys, ends)]
            if rows := [r for r in asked if r["kind"] == "word"]:
                keys = [unplanes(r["keys"]) for r in rows]
                w, inverse, n = _added(keys, [unpacked(r["extra"], len(k)) for r, k in zip(rows, keys)])
                ends = np.cumsum([len(k) for k in keys])
                out += [(r["__g"], bucket, "word", packed(n[inverse[e - len(k) : e]])) for r, k, e in zip(rows, keys, ends)]
                sums = np.bincount((w & ~_CONTEXT).astype(np.int64), n, CLASSES).astype(np.int64)
                out.append((None, bucket, "sums", np.append(sums, (n > 0).sum()).tobytes()))
            return out

        return settle(answer(ask(self.blocked, emit), resolve))

    def words(self) -> tuple[np.ndarray, int]:
        """Training tokens by class, and distinct ones."""

        def run(batches):
            total = np.zeros(CLASSES + 1, np.int64)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total += np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(total)], ["k", "n"])

        rows = self.often.filter("kind = 'sums'").select("reply").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(CLASSES + 1, np.int64)
        for r in rows:
            total[r.k] = r.n
        return total[:-1], int(total[-1])

    def candidates(self) -> DataFrame:
        """(context, s, total, classes, counts, more): each context that occurs ``least`` times, with its suffix and its counts by class of next token, as ``packed`` has them: in ``more`` those from 255 on."""
        found = self._candidates(1, 2)
        for low, high in [(3, self.depth)] * (self.depth > 2):  # in two rounds, which halves what is shuffled at once
            found = found.union(self._candidates(low, high))
        return found

    def _candidates(self, low: int, high: int) -> DataFrame:
        """Those of ``low`` to ``high`` words."""
        depth, least, n_buckets = min(self.depth, high), self.least, self.buckets
        _free(self.spark)

        def work(part, by):
            part = _in_order(part)
            t, ids, hits = _found(part, by, depth, n_buckets) if low == 1 else _placed(part, by, depth)
            places = _bitmap(hits) if low == 1 else b""
            learnt, group, out = _learnt(t, part), t.token & ~_CONTEXT, []
            hits = [hit & learnt for hit in hits]
            if low == 1:
                u, c = np.unique((ids[0] | group)[hits[0]], return_counts=True)
                out = [(b, 0, "one", planes(u[i:j]), packed(c[i:j])) for b, i, j in split_buckets(u, n_buckets)]
                g = part.column("__g")[0].as_py()
                out.append((g % n_buckets, g, "places", places, None))
            for x, s, hit in list(zip(ids[1:], ids, hits[1:]))[max(0, low - 2) :]:
                order, keys, new = ordered((x | group)[hit])
                u, above = keys[new], s[hit][order[new]]
                c = np.diff(np.append(np.flatnonzero(new), len(keys)))
                own = np.ones(len(u), bool)  # the first class of each context: it brings the suffix along
                own[1:] = (u[1:] ^ u[:-1]) & _CONTEXT != 0
                out += [(b, 0, "more", planes(u[i:j]), above[i:j][own[i:j]].tobytes() + packed(c[i:j])) for b, i, j in split_buckets(u, n_buckets)]
            return ask_rows(out)

        def run(key, part):
            keys, counts, own, above, places = [], [], [], [], []
            for r in part.to_pylist():
                if r["kind"] == "places":
                    places.append((r["__g"], None, None, r["keys"], None, None))
                    continue
                u = unplanes(r["keys"])
                first = np.zeros(len(u), bool)
                if r["kind"] == "more":
                    first[0] = True
                    first[1:] = (u[1:] ^ u[:-1]) & _CONTEXT != 0
                n = int(first.sum())
                above.append(np.frombuffer(r["extra"], U64, n))
                own.append(first)
                keys.append(u)
                counts.append(unpacked(r["extra"][8 * n :], len(u)))
            passed = pa.table([pa.array(c, t) for c, t in zip(list(zip(*places)) or [()] * 6, CANDIDATE_TYPES)], names=CANDIDATE)
            if not keys:
                return passed
            u, place, n = _added(keys, counts)
            new = np.ones(len(u), bool)
            np.not_equal(u[1:] & _CONTEXT, u[:-1] & _CONTEXT, out=new[1:])
            at, which = np.flatnonzero(new), np.cumsum(new) - 1
            total, s = np.add.reduceat(n, at), np.zeros(len(at), U64)
            s[which[place[np.concatenate(own)]]] = np.concatenate(above)
            often = total >= least
            keep = often[which]
            n, large, ends = n[keep], n[keep] >= 255, np.cumsum(np.diff(np.append(at, len(u)))[often])
            cols = [
                *((u[at] & _CONTEXT)[often].view(np.int64), s[often].view(np.int64), total[often]),
                _pieces((u[keep] & ~_CONTEXT).astype(np.uint8), ends),
                _pieces(np.minimum(n, 255).astype(np.uint8), ends),
                _pieces(n[large].view(np.uint8), 8 * np.append(0, np.cumsum(large))[ends]),
            ]
            return pa.concat_tables([pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=CANDIDATE), passed])

        known = self.often.filter("kind = 'often'") if low == 1 else self.places
        out = settle(finish(self.blocked, known, work, ASK).groupBy("__b").applyInArrow(run, "context long, s long, total long, classes binary, counts binary, more binary"))
        if low == 1:
            self.places = out.filter("total IS NULL").select(F.col("context").alias("__g"), F.lit(0).alias("__b"), F.lit("places").alias("kind"), F.col("classes").alias("reply"))
        return out.filter("total IS NOT NULL")

    @cached_property
    def places(self) -> DataFrame:
        """Replies with a bit for each place of a block and each length of one and two words, if its context may occur often; a by-product of the candidates."""
        depth, n_buckets = self.depth, self.buckets

        def work(part, by):
            part = _in_order(part)
            return reply_rows([(part.column("__g")[0].as_py(), 0, "places", _bitmap(_found(part, by, depth, n_buckets)[2]))])

        return settle(finish(self.blocked, self.often.filter("kind = 'often'"), work, REPLY))

    def grow(self, share: float = 0.0, gain: float = GAIN) -> Tree:
        root, n_words = self.words()
        tokens = int(root.sum())
        known = self.candidates().filter(F.col("total") >= share * tokens)
        by_class = ("classes", "counts", "more")
        upper = known.select(F.col("context").alias("s"), *(F.col(c).alias(f"{c}2") for c in by_class))
        columns = ["context", "s", "total", *by_class, *(f"{c}2" for c in by_class)]
        nothing = [F.lit(None).cast("binary").alias(f"{c}2") for c in by_class]
        both = known.filter("s = 0").select(*columns[:6], *nothing).union(known.filter("s <> 0").join(upper, "s").select(*columns))

        def run(batches):
            def counts(classes, n, more):
                """Row, class and count."""
                sizes, x = _joined(classes)
                n = _joined(n)[1].astype(np.int64)
                n[n == 255] = _joined(more)[1].view(np.int64)
                return np.repeat(np.arange(len(sizes)), sizes), x, n

            for batch in batches:
                row, x, n = counts(*batch.columns[6:9])
                above = np.zeros((batch.num_rows, CLASSES))
                above[row, x] = n
                above[np.bincount(row, minlength=len(above)) == 0] = root
                d = divergence(*counts(*batch.columns[3:6]), above)
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(d - (CLASSES - 1) / 2 >= gain)) for x in batch.columns[:3]], ["context", "s", "total"])

        level = kept = settle(both.mapInArrow(run, "context long, s long, total long"))
        for _ in range(self.depth - 1):  # suffixes of what is kept
            level = settle(known.select("context", "s", "total").join(level.filter("s <> 0").select(F.col("s").alias("context")).distinct(), "context", "left_semi"))
            kept = kept.union(level)
        return Tree(settle(kept.select("context", "total").distinct()), tokens, n_words, self.least, self.depth)


def _pieces(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: consecutive pieces of some bytes, up to ``ends``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of binary values, null ones' zero, and all their bytes."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset :][: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.diff(ends), np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def divergence(row: np.ndarray, column: np.ndarray, n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """n times the Kullback-Leibler divergence of each row of counts, given by those that are not zero, from the row of its suffix, in nats."""
    p, q = n / np.bincount(row, n, len(above))[row], above[row, column] / above.sum(axis=1)[row]
    with np.errstate(divide="ignore"):
        return np.bincount(row, n * np.log(p / q), len(above))


def _learnt(t: Tokens, part: pa.Table) -> np.ndarray:
    return np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), t.lengths)


def _in_order(part: pa.Table) -> pa.Table:
    """A block's rows in the order that bits of its places refer to; rows equal in these columns are alike."""
    return part.sort_by([(c, "ascending") for c in ("doc_id", "held_out", "text")])


def _bitmap(masks: list[np.ndarray]) -> bytes:
    return np.packbits(np.concatenate(masks)).tobytes()


def _masks(raw: bytes, k: int, n: int) -> list[np.ndarray]:
    return list(np.unpackbits(np.frombuffer(raw, np.uint8), count=k * n).view(bool).reshape(k, n))


def _found(part: pa.Table, by: dict, depth: int, n_buckets: int) -> tuple:
    """Tokens; the ids of their contexts of one and two words; masks of those that may occur often, as do then their suffixes."""
    t = Tokens(texts(part.column("text")), depth)
    ids = t.contexts(2)
    found = Distinct(np.concatenate(ids))
    often = _bits(by, "often", found.u, n_buckets)
    return t, ids, list(np.logical_and.accumulate(found.spread(often).reshape(len(ids), -1)))


def _placed(part: pa.Table, by: dict, depth: int) -> tuple:
    """Tokens; the ids of their contexts by length, where the masks are set; the masks of those that may occur often, from the block's bits."""
    t = Tokens(texts(part.column("text")), depth)
    ids = t.contexts(2)
    hits = _masks(by["places", 0], len(ids), len(t.token))
    before = np.arange(len(t.token)) - 1  # a text's first token stands for the one before it
    before[t.first] = t.first
    for k in range(3, depth + 1):
        hits.append(hits[1] & hits[-1][before])
        ids.append(t.deeper(k, hits[-1]))
    return t, ids, hits


def _held(ids: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """The contexts at some places, by length."""
    return np.concatenate([x[at] for x, at in zip(ids, places)])


def _totals(totals: np.ndarray) -> bytes:
    """Totals of contexts, zero for those not retained: the number of the others, these as ``packed`` has them, and which they are."""
    some = totals[totals > 0]
    return np.int32(len(some)).tobytes() + packed(some) + np.packbits(totals > 0).tobytes()


def _some_totals(raw: bytes) -> np.ndarray:
    """The totals in it that are not zero."""
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    large = int((np.frombuffer(raw, np.uint8, n, 4) == 255).sum())
    return unpacked(raw[4 : 4 + n + 8 * large], n)


def _all_totals(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[np.unpackbits(np.frombuffer(raw, np.uint8)[len(raw) - -(-n // 8) :], count=n).view(bool)] = _some_totals(raw)
    return out


def grow(train: DataFrame, share: float = 0.0, gain: float = GAIN, least: int = LEAST, depth: int = DEPTH) -> Tree:
    """The tree of some texts; ``share`` raises the least count to that share of all tokens."""
    return Blocks(train.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(False).alias("held_out")), least, depth).grow(share, gain)


COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, tree: Tree | None = None, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    dealt = Blocks(docs, tree.least if tree else LEAST, tree.depth if tree else DEPTH)
    tree = tree or dealt.grow()
    depth, n_buckets, tokens, space = dealt.depth, dealt.buckets, tree.tokens, tree.tokens + tree.distinct + 1
    retained = tree.kept.withColumn("__b", F.shiftrightunsigned("context", 64 - (n_buckets.bit_length() - 1)).cast("int"))

    def wanted(part, by):
        part = _in_order(part)
        _, ids, hits = _placed(part, by, depth)
        g, keys = part.column("__g")[0].as_py(), _held(ids, hits)
        keys.sort()
        u = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        return ask_rows([(b, g, "kept", planes(u[i:j]), None) for b, i, j in split_buckets(u, n_buckets)])

    def chosen(key, asked, tree_part):
        tree_part = tree_part.sort_by("context")  # as signed numbers: one bucket is on one side of zero
        contexts, totals = tree_part.column("context").to_numpy().view(U64), np.append(tree_part.column("total").to_numpy(), 0)
        out = []
        for r in asked.to_pylist():
            keys = unplanes(r["keys"])
            at = np.searchsorted(contexts, keys)
            here = np.append(contexts, U64(0))[at] == keys
            out.append((r["__g"], key[0].as_py(), r["kind"], _totals(np.where(here, totals[at], 0))))
        return reply_rows(out)

    places = dealt.places
    _free(docs.sparkSession)
    kept = settle(finish(dealt.blocked, places, wanted, ASK).groupBy("__b").cogroup(retained.groupBy("__b")).applyInArrow(chosen, REPLY))
    _free(docs.sparkSession)

    def pairs_of(t, ids, places):
        token = mix(t.token)
        return np.concatenate([mix(x[at] + token[at]) & _EVEN for x, at in zip(ids, places)])

    def emit(part, by):
        part = _in_order(part)
        t, ids, hits = _placed(part, by, depth)
        asked = Distinct(_held(ids, hits))
        totals = np.zeros(len(asked.u), bool)
        for b, i, j in split_buckets(asked.u, n_buckets):
            totals[i:j] = _all_totals(by["kept", b], j - i) > 0
        held, done = asked.spread(totals), 0
        for hit in hits:
            n = int(hit.sum())
            hit[hit], done = held[done : done + n], done + n
        places = [np.flatnonzero(hit) for hit in hits]
        learnt, g = _learnt(t, part), part.column("__g")[0].as_py()
        u, c = flagged(pairs_of(t, ids, places), np.concatenate([learnt[at] for at in places]))
        return ask_rows([(b, g, "count", planes(u[i:j]), packed(c[i:j])) for b, i, j in split_buckets(u, n_buckets)] + [(g % n_buckets, g, "retained", _bitmap(hits), None)])

    def resolve(bucket, rows):
        out = [(r["__g"], bucket, "retained", r["keys"]) for r in rows if r["kind"] == "retained"]
        if rows := [r for r in rows if r["kind"] == "count"]:
            keys = [unplanes(r["keys"]) for r in rows]
            _, inverse, c = _added(keys, [unpacked(r["extra"], len(k)) for r, k in zip(rows, keys)])
            ends = np.cumsum([len(k) for k in keys])
            out += [(r["__g"], bucket, "count", packed(c[inverse[e - len(k) : e]])) for r, k, e in zip(rows, keys, ends)]
        return out

    def work(part, by):
        part = _in_order(part)
        t = Tokens(texts(part.column("text")), depth)
        ids, hits = t.contexts(2), _masks(by["retained", part.column("__g")[0].as_py() % n_buckets], depth, len(t.token))
        ids += [t.deeper(k, hits[k - 1]) for k in range(3, depth + 1)]  # a retained context's suffix is retained
        places = [np.flatnonzero(hit) for hit in hits]
        pairs, words = Distinct(pairs_of(t, ids, places)), Distinct(t.token)
        totals = [np.empty(0), *(_some_totals(by[key]) for key in sorted(key for key in by if key[0] == "kept"))]
        totals = Distinct(_held(ids, places)).spread(np.concatenate(totals))
        n, counts, done = words.spread(_answered(by, "word", words.u, n_buckets)), pairs.spread(_answered(by, "count", pairs.u, n_buckets)), 0
        base = (n + 1) / space
        p = base.copy()
        for at in places:
            p[at] = (counts[done : done + len(at)] + prior * p[at]) / (totals[done : done + len(at)] + prior)
            done += len(at)
        add = lambda x: np.add.reduceat(x, t.first)
        cols = [part.column("doc_id"), part.column("held_out"), t.lengths, add((n > 0).astype(np.int64)), np.full(len(t.lengths), tokens), add(np.log10(base)), add(np.log10(p))]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in cols], names=[x.split()[0] for x in COLUMNS.split(", ")])

    replies = answer(finish(dealt.blocked, places.union(kept), emit, ASK), resolve)
    return finish(dealt.blocked, dealt.often.filter("kind = 'word'").union(kept).union(replies), work, COLUMNS)


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_model": op10_language_model}
