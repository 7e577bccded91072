"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into chunks that together cover the whole
text; learned filters, eight bytes wide and moved by four, run over each chunk
and four bytes into the next, and each chunk keeps every filter's maximum.  The
document keeps the largest, the smallest and the mean of its chunks' maxima: a
large one shows a pattern somewhere, a small one a chunk without variety, such
as one word repeated.  A small hidden layer combines them into one probability.

Training fits on a sample of labelled documents bounded by ``sample`` (6000 by
default) and ``sample_bytes`` (64 MB), the first by a hash of doc_id, never of
the held-out fold; it runs on the driver and takes the same time for a corpus of
any size.  Scoring is one pass over all texts without a shuffle; short texts go
through together, a long one in slices of its chunks, whose maxima, minima and
sums are folded, so memory does not depend on its length.

Defined results: null and empty texts are scored like each other, from no byte
at all; a null doc_id counts as the empty string for the fold; without any
training row, or with one class only, the score is the share of label 1 (0.5
without rows); labels that repeat or contradict count once each; a labelled
doc_id with several texts trains with the one of the smallest hash; an empty
table gives an empty result; other columns are ignored or, by ``keep_good``,
passed through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import in_batches, shielded, table, texts

SAMPLE, FILTERS, EMBED, STRIDE, CHUNK, HIDDEN = 6000, 32, 8, 4, 128, 16
EPOCHS, BATCH, RATE, DECAY, THRESHOLD = 8, 32, 0.004, 1e-3, 0.3
SLICE, SAMPLE_BYTES = 1 << 18, 64 << 20


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


class Network:
    """Parameters and both directions of the network."""

    def __init__(self, seed: int = 4, prior: float | None = None):
        r = np.random.default_rng(seed)
        f = np.float32
        self.prior = prior
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(f),
            "near": r.normal(0, 0.25, (STRIDE * EMBED, FILTERS)).astype(f), "far": r.normal(0, 0.25, (STRIDE * EMBED, FILTERS)).astype(f),
            "shift": np.zeros(FILTERS, f),
            "w1": r.normal(0, 0.1, (3 * FILTERS + 1, HIDDEN)).astype(f), "b1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, 0.3, HIDDEN).astype(f), "b2": np.ones(1, f),
        }

    @staticmethod
    def layout(raw: list[bytes]):
        """Byte rows of STRIDE, the windows' first rows, and where the chunks and documents start."""
        rows = np.array([max(2, -(-len(x) // STRIDE)) for x in raw], np.int64)
        padded = b"".join(x.ljust(STRIDE * n, b"\0") for x, n in zip(raw, rows.tolist()))
        codes = np.frombuffer(padded, np.uint8).reshape(-1, STRIDE)
        windows = rows - 1
        pieces = np.maximum(1, windows // CHUNK)  # the rest of a chunk joins the last ones: none is short but that of a short text
        doc = np.repeat(np.arange(len(raw)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.cumsum(windows) - windows
        chunks = begin[doc] + nth * windows[doc] // pieces[doc]
        keep = np.ones(len(codes), bool)
        keep[np.cumsum(rows) - 1] = False
        return codes, np.flatnonzero(keep), chunks, np.cumsum(pieces) - pieces, np.minimum(1.0, windows / CHUNK).astype(np.float32)

    def convolved(self, codes: np.ndarray, first: np.ndarray, chunks: np.ndarray):
        """Embedded rows, filters over the windows, and each chunk's maxima."""
        e = self.p["embed"][codes].reshape(len(codes), -1)
        conv = (e @ self.p["near"])[first] + (e @ self.p["far"])[first + 1]
        return e, conv, np.maximum.reduceat(conv, chunks)

    def combined(self, x: np.ndarray):
        """Probabilities of documents by their pooled filters, and the hidden layer."""
        a = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        z = np.clip((a @ self.p["w2"] + self.p["b2"]).astype(np.float64), -30, 30)
        return 1 / (1 + np.exp(-z)), a

    def forward(self, raw: list[bytes]):
        codes, first, chunks, docs, size = self.layout(raw)
        e, conv, top = self.convolved(codes, first, chunks)
        h = np.maximum(top + self.p["shift"], 0)
        n = np.diff(np.append(docs, len(chunks)))
        x = np.concatenate((np.maximum.reduceat(h, docs), np.minimum.reduceat(h, docs), np.add.reduceat(h, docs) / n[:, None], size[:, None]), axis=1).astype(self.p["w1"].dtype)
        out, a = self.combined(x)
        return out, (codes, first, chunks, docs, e, conv, top, h, n, x, a)

    def score_long(self, text: bytes, slice_bytes: int = SLICE) -> float:
        """``forward`` of one text, a slice of its chunks at a time."""
        rows = max(2, -(-len(text) // STRIDE))
        pieces = max(1, (rows - 1) // CHUNK)
        starts = np.append(np.arange(pieces) * (rows - 1) // pieces, rows - 1)
        most, least, total = np.zeros(FILTERS), np.full(FILTERS, np.inf), np.zeros(FILTERS)
        step = max(1, slice_bytes // (STRIDE * CHUNK))
        for k in range(0, pieces, step):
            own = starts[k : k + step + 1]
            n = int(own[-1] - own[0])  # windows; they reach into one row more
            codes = np.frombuffer(text[STRIDE * own[0] : STRIDE * (own[-1] + 1)].ljust(STRIDE * (n + 1), b"\0"), np.uint8).reshape(-1, STRIDE)
            h = np.maximum(self.convolved(codes, np.arange(n), own[:-1] - own[0])[2] + self.p["shift"], 0)
            most, least, total = np.maximum(most, h.max(axis=0)), np.minimum(least, h.min(axis=0)), total + h.sum(axis=0, dtype=np.float64)
        x = np.concatenate((most, least, total / pieces, [min(1.0, (rows - 1) / CHUNK)])).astype(self.p["w1"].dtype)
        return float(self.combined(x[None])[0][0])

    def score(self, raw: list[bytes], slice_bytes: int = SLICE) -> np.ndarray:
        """Probabilities of any texts, in bounded memory."""
        if self.prior is not None:
            return np.full(len(raw), self.prior)
        out, part, held = np.empty(len(raw)), [], 0

        def flush():
            if part:
                out[part] = self.forward([raw[i] for i in part])[0]

        for k, x in enumerate(raw):
            if len(x) >= slice_bytes:
                out[k] = self.score_long(x, slice_bytes)
                continue
            part.append(k)
            held += len(x)
            if held >= slice_bytes:
                flush()
                part, held = [], 0
        flush()
        return out

    def gradients(self, raw: list[bytes], label: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        out, (codes, first, chunks, docs, e, conv, top, h, n, x, a) = self.forward(raw)
        dz = ((out - label) / len(raw)).astype(p["w1"].dtype)
        g["w2"], g["b2"] = a.T @ dz, dz.sum(keepdims=True)
        da = np.outer(dz, p["w2"]) * (a > 0)
        g["w1"], g["b1"] = x.T @ da, da.sum(axis=0)
        dx = da @ p["w1"].T
        most, least, mean = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
        spread = lambda v: np.repeat(v, n, axis=0)
        dh = spread(mean / n[:, None])
        for part, d in ((x[:, :FILTERS], most), (x[:, FILTERS : 2 * FILTERS], least)):
            tie = h == spread(part)
            dh = dh + tie * spread(d / np.add.reduceat(tie, docs, dtype=np.int64))  # equal chunks share
        dh = dh * (h > 0)
        g["shift"] = dh.sum(axis=0)
        # only the window that gave a chunk its maximum has a part in it
        lengths = np.diff(np.append(chunks, len(conv)))
        at, f = np.nonzero(conv == np.repeat(top, lengths, axis=0))
        chunk = np.repeat(np.arange(len(chunks)), lengths)[at]
        _, one = np.unique(chunk * FILTERS + f, return_index=True)
        at, f, chunk = at[one], f[one], chunk[one]
        d, row = dh[chunk, f], first[at]
        g["embed"] = np.zeros_like(p["embed"])
        for name, r in (("near", row), ("far", row + 1)):
            g[name] = np.empty_like(p[name])
            for slot in range(STRIDE):  # by byte and filter first: both gradients are products with these sums
                by = np.bincount(codes[r, slot].astype(np.int64) * FILTERS + f, d, 256 * FILTERS).reshape(256, FILTERS).astype(p[name].dtype)
                own = slice(slot * EMBED, (slot + 1) * EMBED)
                g[name][own] = p["embed"].T @ by
                g["embed"] += by @ p[name][own].T
        return g

    def fit(self, raw: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Network:
        """Adam on the cross-entropy; batches are of BATCH documents, each shifted by up to three zero bytes against the stride."""
        r, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        epochs = max(epochs, min(250, 16_000 // max(1, len(raw))))  # few rows: about as many steps
        for epoch in range(epochs):
            order = r.permutation(len(raw))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                t += 1
                rate = RATE * min(1, t / 50) * (1 - epoch / epochs)
                shifted = [b"\0" * by + raw[i] for by, i in zip(r.integers(0, STRIDE, len(part)).tolist(), part)]
                for name, g in self.gradients(shifted, label[part]).items():
                    if self.p[name].ndim == 2 and name != "embed" or name == "w2":
                        g = g + DECAY * self.p[name]
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fits on at most ``sample`` labelled documents outside the held-out fold, of at most ``sample_bytes`` together."""
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct().orderBy(*order).limit(sample)
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of at most ``sample`` rows
    rows = one.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    label = np.array([r.label for r in rows], np.float64)
    if len(set(label)) < 2:
        return Network(prior=float(label.mean()) if len(label) else 0.5)
    return Network().fit([r.text.encode() for r in rows], label)


def with_scores(docs: DataFrame, network: Network) -> DataFrame:
    """``docs``, which has no column of that name yet, and a column __score."""
    sent, names = docs.sparkSession.sparkContext.broadcast(network), docs.columns

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in texts(batch.column(names.index("text")))]
            yield batch.append_column("__score", pa.array(sent.value.score(raw)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs, run, f"{fields}, __score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    network = train(docs, labels, sample)
    return shielded(docs, lambda d: with_scores(d, network).filter(F.col("__score") >= THRESHOLD))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
