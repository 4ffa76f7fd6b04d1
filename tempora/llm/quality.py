"""Quality classifier: a byte-level convolutional network written in numpy.

Learned filters look at overlapping chunks of WIDTH bytes, STRIDE apart, over the whole
document; each filter's largest response anywhere in the document is kept and the kept
responses are combined by one logistic unit.

Defined results: null and empty texts are scored like a document of padding only; with no
usable label the score is 0.5 everywhere; repeated rows are scored each; columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import stream, table

WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 6, 24
PAD = 256
#: Labelled documents that are used for fitting, for either label, and their length limit in characters.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 1500, 20_000
EPOCHS, RATE, BATCH = 8, 0.01, 64


class ByteNet:
    """emb: 257 x EMBED, w: WIDTH*EMBED x FILTERS, b, v: FILTERS, c: scalar, all float32."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.emb[PAD] = 0
        self.w = r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, self.w, self.b, self.v, self.c]

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, padded so that chunks tile them; the first chunk and the number of chunks of each."""
        chunks = np.array([max(0, -(-(len(t) - WIDTH) // STRIDE)) + 1 for t in texts], np.int64)
        spans = (chunks + 1) * STRIDE  # the last start of a span would reach into the next text
        begins = np.concatenate([[0], np.cumsum(spans)])
        symbols = np.full(begins[-1] + WIDTH, PAD, np.int16)
        for t, at in zip(texts, begins[:-1], strict=True):
            symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
        return symbols, begins[:-1] // STRIDE, chunks

    def responses(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = self.emb[symbols].ravel()
        n = (len(symbols) - WIDTH) // STRIDE
        views = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
        return views, np.maximum(views @ self.w + self.b, 0)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        symbols, first, chunks = self.layout(texts)
        _, act = self.responses(symbols)
        act[first + chunks] = 0  # starts that straddle two texts
        return np.maximum.reduceat(act, first, axis=0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.pooled(texts).astype(np.float64) @ self.v + float(self.c[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        symbols, first, chunks = self.layout(texts)
        views, act = self.responses(symbols)
        n = len(texts)
        where = np.stack([act[s : s + k].argmax(0) + s for s, k in zip(first, chunks, strict=True)])
        h = act[where, np.arange(FILTERS)]
        p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c[0], -30, 30)))
        g = ((p - target) * weight / n).astype(np.float32)
        dh = g[:, None] * self.v * (h > 0)
        picked = views[where]  # n x FILTERS x WIDTH*EMBED
        dw = np.einsum("nf,nfk->kf", dh, picked)
        dx = np.einsum("nf,kf->nfk", dh, self.w).reshape(n, FILTERS, WIDTH, EMBED)
        demb = np.zeros_like(self.emb)
        np.add.at(demb, symbols[where[:, :, None] * STRIDE + np.arange(WIDTH)], dx)
        demb[PAD] = 0
        return [demb, dw, dh.sum(0), g @ h, np.array([g.sum()], np.float32)]

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
        y, r = np.array(labels, np.float32), np.random.default_rng(seed)
        if not len(y):
            self.v[:] = 0
            return self
        # the sample is balanced by label; a rate of either label keeps the 0.5 point in the middle
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        m = [np.zeros_like(p) for p in self.parameters()]
        s = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order, rate = r.permutation(len(texts)), RATE * (0.5 if epoch >= epochs // 2 else 1.0)
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for p, g, mm, ss in zip(self.parameters(), self.gradients([texts[i] for i in pick], y[pick], weight[pick]), m, s, strict=True):
                    mm += 0.1 * (g - mm)
                    ss += 0.01 * (g * g - ss)
                    p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)
        return self


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[bytes], list[int]]:
    """At most per_label documents of either label, the least by a hash of their id: a bounded fit.

    Labels are taken only from rows whose crc32(doc_id as text) mod 5 is not 0. The ids are
    chosen among the labels first, so no text is shuffled.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    ids = dict(picked.collect())  # at most 2 * per_label rows
    if not ids:
        return [], []
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(ids.items()), "doc_id long, quality int"))
    rows = docs.select("doc_id", F.col("text").alias("t")).where(F.length("text") <= SAMPLE_CHARS).join(wanted, "doc_id").dropDuplicates(["doc_id"])
    got = sorted(rows.select("doc_id", "t", "quality").collect())
    return [(t or "").encode("utf-8", "replace") for _, t, _ in got], [q for _, _, q in got]


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode("utf-8", "replace") for t in block.column(1).to_pylist()]
        out = np.empty(len(texts))
        for rows in within(texts, 256 << 10):
            out[rows.start : rows.stop] = shared.value.scores(texts[rows.start : rows.stop])
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(out)], ["doc_id", "score"])

    return stream(docs, ["doc_id", "text"], step, "doc_id long, score double")


def within(texts: list[bytes], limit: int) -> Iterator[range]:
    """Consecutive ranges of texts of about `limit` bytes together."""
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > limit:
            yield range(begin, i)
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield range(begin, len(texts))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = ByteNet()
    texts, labels = training_sample(docs, table(spark, sf_dir, "labels"))
    if len(set(labels)) == 2:
        net.fit(texts, labels)
    else:
        net.fit([], [])
        net.c[0] = 0.0
    return score(docs, net).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
