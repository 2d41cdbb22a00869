"""Quality by a small byte-level convolutional network, in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes run over the text every ``STRIDE`` bytes, and each filter's
largest response is taken in every chunk. Chunks overlap by half and cover the whole text: a chunk is two neighbouring
blocks, so its maximum is that of its blocks' maxima. The chunks' maxima are combined by their mean and their maximum
into one logistic probability. Fitting sees a bounded sample, scoring is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import crc_mod, flat, labelled_sample, slices
from isolates.session import read_table

#: Labelled texts that the fit may see, and passes over them.
MAX_FIT_ROWS, EPOCHS, BATCH = 4000, 8, 64
#: Bytes of text whose gradient is taken at once; a longer text is taken alone, whole.
FIT_SLICE = 1 << 18
EMBED, STRIDE, FILTERS = 8, 4, 32
WIDTH = 2 * STRIDE
#: Bytes of a block; a chunk is two.
BLOCK = 256
SLICE = 1 << 18


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, blocks = padded(*flat(column))
        mean, top = combine(self.peaks(data), blocks)
        return 1 / (1 + np.exp(-np.clip(np.hstack([mean, top]) @ self.out + self.bias, -40, 40)))

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of every filter at every place, by block. A window is two strides, so it is the sum of two products."""
        x = np.take(self.embed, np.append(data, np.zeros(STRIDE, np.uint8)), axis=0).reshape(-1, STRIDE * EMBED)
        half = STRIDE * EMBED
        out = x[:-1] @ self.filters[:half]
        out += x[1:] @ self.filters[half:]
        return out.reshape(-1, BLOCK // STRIDE, FILTERS)

    def peaks(self, data: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each block, none below zero."""
        return np.maximum(0, self.responses(data).max(axis=1) + self.shift)

    def peaks_and_places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        response = self.responses(data)
        at = response.argmax(axis=1)
        return np.maximum(0, np.take_along_axis(response, at[:, None], axis=1)[:, 0] + self.shift), at


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text filled up with zeros to whole blocks (an empty one has one block), and where its blocks begin."""
    blocks = np.append(0, np.cumsum(np.maximum(1, -(-np.diff(offsets) // BLOCK))))
    out = np.zeros(blocks[-1] * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(blocks[:-1] * BLOCK - offsets[:-1], np.diff(offsets))] = data
    return out, blocks


def pairs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two blocks of each chunk, and where each text's chunks begin; a text of one block has one chunk."""
    n = np.diff(blocks)
    chunks = np.maximum(1, n - 1)
    begin = np.append(0, np.cumsum(chunks))
    first = np.arange(begin[-1]) + np.repeat(blocks[:-1] - begin[:-1], chunks)
    return first, first + np.repeat(n > 1, chunks), begin


def combine(peak: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over each text's chunks of the chunks' maxima."""
    if len(blocks) == 1:
        return np.zeros((0, FILTERS)), np.zeros((0, FILTERS))
    a, b, begin = pairs(blocks)
    chunk = np.maximum(peak[a], peak[b])
    return np.add.reduceat(chunk, begin[:-1], axis=0) / np.diff(begin)[:, None], np.maximum.reduceat(chunk, begin[:-1], axis=0)


def gradients(net: Network, texts: list[bytes], y: np.ndarray, n: int) -> list[np.ndarray]:
    """Of the mean loss over ``n`` texts, what these whole texts add for each parameter; the maxima's windows get it."""
    data, blocks = padded(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    peak, at = net.peaks_and_places(data)
    mean, top = combine(peak, blocks)
    features = np.hstack([mean, top])
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.bias, -30, 30)))
    g = ((p - y) / n).astype(np.float32)
    a, b, begin = pairs(blocks)
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    chunk = np.maximum(peak[a], peak[b])
    back = g[text, None] * (net.out[:FILTERS] / np.diff(begin)[text, None] + net.out[FILTERS:] * (chunk >= top[text]))
    winner = np.where(peak[a] >= peak[b], a[:, None], b[:, None])
    back = np.where(chunk > 0, back, 0).astype(np.float32)
    d_peak = np.zeros_like(peak)
    np.add.at(d_peak, (winner, np.arange(FILTERS)), back)
    block, f = np.nonzero(d_peak)
    start = block * BLOCK + at[block, f] * STRIDE
    grad = d_peak[block, f]
    window = np.append(data, np.zeros(WIDTH, np.uint8))[start[:, None] + np.arange(WIDTH)]
    d_filters = np.zeros_like(net.filters)
    x = net.embed[window].reshape(len(start), -1)
    for k in range(FILTERS):
        mine = f == k
        d_filters[:, k] = grad[mine] @ x[mine]
    d_x = (grad[:, None] * net.filters.T[f]).reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(window.ravel(), d_x[:, e], 256) for e in range(EMBED)], axis=1)
    return [d_embed, d_filters, d_peak.sum(axis=0), features.T @ g, g.sum()]


def fit(texts: list[str], y: np.ndarray, seed: int = 7) -> Network:
    """Train by Adam on mini-batches of whole texts."""
    rng = np.random.default_rng(seed)
    share = float((y.sum() + 0.5) / (len(y) + 1.0))
    net = Network(
        (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
        (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS, np.float32),
        float(np.log(share / (1 - share))),
    )
    if not 0 < y.sum() < len(y):
        return net
    net.out[:] = rng.standard_normal(2 * FILTERS) * 0.1
    raw = [t.encode() if t else b"" for t in texts]
    size = np.array([len(t) for t in raw])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.embed, net.filters, net.shift, net.out)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(raw))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            part = np.cumsum(size[batch]) // FIT_SLICE
            sums = None
            for k in np.unique(part):
                chosen = batch[part == k]
                found = gradients(net, [raw[i] for i in chosen], y[chosen], len(batch))
                sums = found if sums is None else [a + b for a, b in zip(sums, found)]
            sums[3] = sums[3] + 1e-4 * net.out
            step += 1
            for q, d, (m, v) in zip((net.embed, net.filters, net.shift, net.out), sums, state):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                q -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            net.bias -= 0.05 * float(sums[4])
    return net


def quality(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the chance that the text is of good quality.

    ``learn``: which labelled rows (columns doc_id, quality) the fit may see; null labels and ids are left out. Null and
    empty texts are scored as one block of zeros, texts of any length by all their chunks. Repeated rows score alike and
    texts that tie do too, other columns are ignored, and empty tables are fine: without both labels scores are the share of label 1.
    """
    net = fit(*labelled_sample(docs, labels, "quality", learn, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")).astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality(docs, labels, crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
