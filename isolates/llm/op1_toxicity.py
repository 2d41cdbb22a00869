"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are word and word-beginning patterns that stand out in toxic or in other texts of the labelled sample, and
rules on a text's look. The label model knows only the votes: expectation-maximization estimates how often each voter
fires on either class and how voters go together within a class; voters that repeat each other share their weight.
A logistic regression over several thousand patterns learns from the model's posteriors, and its scale is set on the
sample's labels. Fitting sees a bounded sample, scoring is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import ALNUM, LOWER_TABLE, RollingHash, crc_mod, flat, labelled_sample, slices, spans
from isolates.session import read_table

#: Labelled texts that the fit may see.
MAX_FIT_ROWS = 4000
#: Score from which on a text counts as toxic, in the query and in the pipeline's stage.
LIMIT = 0.3
#: Bytes of the word beginnings that count as patterns, beside whole words.
BEGINNINGS = (5, 6, 7, 8, 9)
MIN_TEXTS = 4
#: A pattern also counts as one that a text has at least so many times.
LEVELS = (1, 2, 3, 5)
VOTERS_FOR, VOTERS_AGAINST = 96, 24
FEATURES = 1024


def patterns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of all texts, and the text of each."""
    data, offsets = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
    starts, ends, first = spans(data, offsets, ALNUM)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rolling = RollingHash(data)
    found, texts = [rolling.of(starts, ends)], [owner]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n)
        found.append(rolling.of(starts[long], starts[long] + n) ^ np.uint64(n))
        texts.append(owner[long])
    return np.concatenate(found), np.concatenate(texts)


def look(column: pa.Array) -> np.ndarray:
    """Shares of capitals, marks and digits in each text."""
    out = [np.zeros((0, 3))]
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=1 << 20):
        data, offsets = flat(batch.column("text"))
        kinds = [(data >= 65) & (data <= 90), (data == 33) | (data == 63), (data >= 48) & (data <= 57)]
        n = np.maximum(1, np.diff(offsets))
        sums = [np.append(0, np.cumsum(k, dtype=np.int64)) for k in kinds]
        out.append(np.stack([(s[offsets[1:]] - s[offsets[:-1]]) / n for s in sums], axis=1))
    return np.vstack(out)


@dataclass
class Model:
    """Sorted pattern hashes, a weight for each level that a text's count of the pattern reaches, and the start value."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        h, text = patterns(column)
        out = np.full(len(column), self.bias)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            pair, count = np.unique(text[hit] * len(self.keys) + at[hit], return_counts=True)
            for i, level in enumerate(LEVELS):
                on = pair[count >= level]
                out += np.bincount(on // len(self.keys), self.weights[on % len(self.keys), i], len(column))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row of ``votes`` (1, -1, or 0 for none), from the votes alone.

    Each voter has its own chance of each vote given the class. Correlations within the classes are estimated from
    the posteriors, and a voter's say is divided by how much of its vote others repeat.
    """
    q = np.where(votes.sum(axis=1) > 0, 0.9, 0.5 * prior)
    kinds = [votes == v for v in (-1, 0, 1)]
    say = np.ones(votes.shape[1])
    for i in range(rounds):
        gain = np.zeros(votes.shape)
        for k in kinds:
            p1 = (q @ k + 0.5) / (q.sum() + 1.5)
            p0 = ((1 - q) @ k + 0.5) / ((1 - q).sum() + 1.5)
            gain += k * np.log(p1 / p0)
        if i in (10, 15):  # once the classes are told apart, what is left is correlation within them
            together = np.zeros((votes.shape[1],) * 2)
            for w in (q, 1 - q):
                mean = (w @ votes) / w.sum()
                centred = (votes - mean) * np.sqrt(w)[:, None]
                cov = centred.T @ centred / w.sum()
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                together += np.clip(cov / sd / sd[:, None], 0, 1) / 2
            say = 1 / np.maximum(1, together.sum(axis=1))
        logit = np.log(prior / (1 - prior)) + gain @ say
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Patterns of at least ``MIN_TEXTS`` texts: their sorted hashes, and for each (pattern, text) numbers and count."""
    hashes, texts, counts, base = [], [], [], 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=1 << 20):
        h, text = patterns(batch.column("text"))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, np.int64)
        hashes.append(h[head])
        texts.append((text[head] + base).astype(np.int32))
        counts.append(np.minimum(np.diff(np.append(head, len(h))), 255).astype(np.uint8))
        base += batch.num_rows
    h, text, count = map(np.concatenate, (hashes, texts, counts))
    hashes.clear()
    ranked = np.sort(h)
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    keys = ranked[head[np.diff(np.append(head, len(ranked))) >= MIN_TEXTS]]
    del ranked
    if not len(keys):
        return keys, np.zeros(0, np.int32), text[:0], count[:0]
    key = np.minimum(np.searchsorted(keys, h), len(keys) - 1).astype(np.int32)
    on = keys[key] == h
    return keys, key[on], text[on], count[on]


def fit(texts: list[str], y: np.ndarray) -> Model:
    """A model from labelled texts; without both classes it gives their share for every text."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    column = pa.array(texts, pa.string())
    keys, key, text, count = counted(column)
    # a feature is a pattern at a level: texts that have it so many times
    feature = np.concatenate([key[count >= n] * len(LEVELS) + i for i, n in enumerate(LEVELS)])
    row = np.concatenate([text[count >= n] for n in LEVELS])
    del key, text, count
    df = np.bincount(feature, minlength=len(keys) * len(LEVELS))

    def stands_out(target):
        n1, n0 = target.sum() + 1e-3, (1 - target).sum() + 1e-3
        df1 = np.bincount(feature, target[row], len(df))
        a, b = (df1 + 0.1) / (n1 + 0.2), (df - df1 + 0.1) / (n0 + 0.2)
        z = (a - b) / np.sqrt((a * (1 - np.minimum(a, 1)) + 1e-4) / n1 + (b * (1 - np.minimum(b, 1)) + 1e-4) / n0)
        return np.where(df >= MIN_TEXTS, z, 0)

    def matrix(chosen):
        slot = np.full(len(df), -1)
        slot[chosen] = np.arange(len(chosen))
        on = slot[feature] >= 0
        out = np.zeros((len(y), len(chosen)), np.float32)
        out[row[on], slot[feature[on]]] = 1
        return out

    def voters(order, most):
        """The first of ``order`` that do not repeat an earlier one."""
        x = matrix(order)
        unit = x - x.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=0), 1e-6)
        near = unit.T @ unit > 0.8
        kept: list[int] = []
        for i in range(len(order)):
            if len(kept) < most and not near[i, kept].any():
                kept.append(i)
        return x[:, kept]

    z = stands_out(y.astype(float))
    lead, against = np.argsort(-z)[:800], np.argsort(z)[:200]
    for_it, not_it = voters(lead[z[lead] > 3], VOTERS_FOR), voters(against[z[against] < -3], VOTERS_AGAINST)
    ways = look(column) > np.array([0.3, 0.02, 0.1])
    none = np.where(for_it.any(axis=1), 0, -1)[:, None]
    q = label_model(np.hstack([for_it, -not_it, ways, none]).astype(np.float32), float(share))

    z = np.abs(stands_out(q))
    used = np.argsort(-z)[:FEATURES]
    used = np.sort(used[z[used] > 0])
    x = np.hstack([matrix(used), np.ones((len(y), 1), np.float32)])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(len(used), 1.0), 1e-6)
    for _ in range(12):  # Newton steps for the logistic loss on the posteriors
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-4)[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, x.T @ (p - q) + ridge * w)
    logit = x @ w
    middle = (np.quantile(logit[y == 0], 0.95) + np.quantile(logit[y == 1], 0.05)) / 2
    pair, ab = np.stack([logit - middle, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(200):  # the scale, on the sample's labels; damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(pair @ ab, -30, 30)))
        hessian = (pair * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ pair + 1e-3 * np.eye(2)
        ab -= np.clip(np.linalg.solve(hessian, pair.T @ (p - y) + 1e-3 * (ab - (1, 0))), -1, 1)
    ab[1] -= ab[0] * middle
    a, b = ab
    kept, of = np.unique(used // len(LEVELS), return_inverse=True)
    weights = np.zeros((len(kept), len(LEVELS)))
    weights[of, used % len(LEVELS)] = a * w[:-1]
    return Model(keys[kept], weights, a * w[-1] + b)


def toxicity(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the chance that the text is toxic.

    ``learn``: which labelled rows (columns doc_id, toxic) the fit may see; null labels and ids are left out. A null
    or empty text has no pattern and gets the score of one. Repeated rows score alike, other columns are ignored, and
    empty tables are fine: without both labels every score is the share of label 1, smoothed (0.5 without any).
    """
    model = fit(*labelled_sample(docs, labels, "toxic", learn, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, learn, limit: float = LIMIT, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "toxic", learn, max_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column("text")) < limit))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity(docs, labels, crc_mod("doc_id", 4) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
