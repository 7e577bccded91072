"""SentencePiece encoding and decoding by a shared-prefix forward search.

Texts are marked as SentencePiece marks them (a space before the text, every
space as U+2581) and cut into marked words, across which no piece reaches.
The distinct words of a slice are sorted, which lays them out as the paths of a
trie in depth-first order, and one pass walks the trie: the forward state of
every prefix is computed once and shared by all words that begin with it.

The forward state of a prefix is its best last piece.  For a unigram model that
is Viterbi's: the piece on the best-scored path.  The public model at hand is a
BPE model, for which the best sum of scores is not what SentencePiece returns;
there the state is the one last piece that fits: a segmentation is the BPE
result exactly if each piece is a result by itself and each pair of neighbours
is the BPE result of the two joined, so that the state of a prefix follows from
the states of shorter ones.  Ids equal those of the SentencePiece library.

Characters without a piece become byte pieces, or the unknown piece if the
model has none.  Decoding is exact for every text, except that U+2581 itself
comes back as a space.

Defined results: null and empty texts have no ids and decode to the empty
text; a null doc_id, repeated rows and other columns are passed through or
ignored; an empty table gives an empty result.  A word of any length takes time
in proportion to its length.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, table

MARK = "▁"
#: Fixed values of the model format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SLICE, KEPT_WORDS, KEPT_PAIRS = 1 << 21, 300_000, 1_000_000


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def number(at):
        value = shift = 0
        while True:
            b = raw[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            n, at = number(at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """Pieces, scores and flags of a model file; encodes and decodes."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds, self.kind, self.prefix = [], [], [], UNIGRAM, True
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without character maps and without removal of white space")
                self.prefix = bool(spec.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches across words")
        # further places to cut: line feeds, and between a Latin letter or digit and a mark that follows none in any piece
        cut = "" if any("\n" in p for p in self.ids) else "\n"
        latin = "0-9A-Za-z\u00c0-\u024f"
        after = {p[k] for p in self.ids for k in range(1, len(p)) if re.match(f"[{latin}]", p[k - 1])}
        marks = "".join(re.escape(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in after)
        rest = f"[^{MARK}{cut}{latin}]*[{latin}]*"
        self.words = re.compile((f"{cut}+|(?=[^{cut}])" if cut else "(?s:(?=.))") + f"{MARK}*{rest}(?:[^{MARK}{cut}{latin}{marks}]{rest})*").findall
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.least = min(self.scores) - 10
        # pieces that are a result by themselves, and by their last three characters which lengths there are, longest first
        self.usable = {p: i for p, i in self.ids.items() if self.kind != BPE or self.merged(list(p)) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > 2:
                ends.setdefault(p[-3:], {1, 2}).add(len(p))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}  # words of late and, in ``older``, of before
        self.older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "known": {}, "older": {}}

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: merge the best-scored neighbours, leftmost first, while any are a piece."""
        get, scores = self.ids.get, self.scores
        while True:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                i = get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, where = scores[i], k
            if best is None:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct words."""
        return (self._fitting if self.kind == BPE else self._best)(sorted(words))

    def _fitting(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """BPE: a prefix's state is the id and the start of the last piece that fits; -1 is a character without a piece."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        get, lengths, pairs, n_ids = self.usable.get, self.lengths.get, self.pairs, len(self.pieces)
        out, before, last, begin = {}, "", [-1], [0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    start = end - n
                    if start < 0:
                        continue
                    i = get(word[start:end])
                    if i is None:
                        continue
                    a = last[start]
                    if a < 0:  # at the word's start, or after a character that never merges
                        break
                    fits = pairs.get(a * n_ids + i)
                    if fits is None:
                        x, y = self.pieces[a], self.pieces[i]
                        fits = pairs[a * n_ids + i] = self.merged(list(x + y)) == [x, y]
                    if fits:
                        break
                else:
                    i, start = -1, end - 1
                last.append(i)
                begin.append(start)
            before, at, found = word, len(word), []
            while at:
                i, start = last[at], begin[at]
                found.append((i,) if i >= 0 else self.spelled(word[start:at]))
                at = start
            out[word] = tuple(chain.from_iterable(reversed(found)))
        return out

    def _best(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Unigram, Viterbi: a prefix's state is its best score, and the start of the last piece of that path."""
        out, before, score, begin = {}, "", [0.0], [0]
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            del score[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                paths = [(score[end - 1] + self.least, end - 1)]
                for start in range(max(0, end - self.longest), end):
                    i = self.ids.get(word[start:end])
                    if i is not None:
                        paths.append((score[start] + self.scores[i], start))
                best = max(paths, key=lambda x: x[0])
                score.append(best[0])
                begin.append(best[1])
            before, at, found = word, len(word), []
            while at:
                found.append(self.spelled(word[begin[at] : at]))
                at = begin[at]
            out[word] = tuple(chain.from_iterable(reversed(found)))
        return out

    def spelled(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        if i is not None:
            return (i,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def mark(self, text: str) -> list[str]:
        return self.words((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text.  Words are kept from call to call, at most twice KEPT_WORDS and those of one call."""
        marked = [self.mark(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older.get, []
        for w in set(chain.from_iterable(marked)).difference(known):
            ids = older(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        known.update(self.encode_words(new))
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, ws)), np.int32) for ws in marked]

    def decode(self, ids) -> str:
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


def load(spark, path: str) -> Model:
    """Reads the file where the driver or Spark can find it; tasks get the model, not the path."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return Model(f.read())
    return Model(bytes(spark.read.format("binaryFile").load(path).first().content))


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding gives the text again)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            names, raw, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(raw):
                end, held = at, 0
                while end < len(raw) and held < SLICE:
                    held += len(raw[end] or "")
                    end += 1
                ids = m.encode(raw[at:end])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                same = [m.decode(x.tolist()) == (t or "") for x, t in zip(ids, raw[at:end])]
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([names.slice(at, end - at), pa.array(np.diff(offsets).astype(np.int64)), flat, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])
                at = end

    return in_batches(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give the empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return in_batches(tokens.select("doc_id", "ids"), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark, sf_dir: str, path: str = MODEL) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), load(spark, path))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
