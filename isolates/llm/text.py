"""Columnar text helpers used inside Arrow tasks: whole batches of texts as one byte array with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolates.session import materialise

#: Bytes of text handled at once in a task; a longer single text is handled alone.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()

#: Word bytes of the two word rules. Letters and digits and all bytes of non-ASCII characters; and all but ASCII white space.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``: the remainder that fixes the held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``limit`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (nulls are empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes (never across texts), and the first word of each text."""
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = word[:-1]
        before[edge[:-1]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, as bytes, and where each word starts and ends there."""
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    new_starts = new_ends - lengths
    out = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new_ends] = False
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    out[inside] = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), new_starts, new_ends


#: An odd factor for rolling hashes, and its inverse modulo 2**64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


class RollingHash:
    """Hashes of any byte ranges of one buffer, by prefix sums of byte times power modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            power = np.full(n, FACTOR, np.uint64)
            back = np.full(n + 1, INVERSE, np.uint64)
            if n:
                power[0] = 1
            back[0] = 1
            self.back = np.cumprod(back, dtype=np.uint64)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power, dtype=np.uint64), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def text_key() -> list[Column]:
    """What tells rows of one doc_id apart: hash and size of the text; a null text has a hash and no size."""
    return [F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")]


def same_text(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` (left) joined to rows of ``keys`` (doc_id, hash, size, ...) that stand for them, nulls included.

    Columns of ``keys`` other than these three must have names that ``docs`` has not.
    """
    keys = keys.withColumnsRenamed({"doc_id": "__id", "hash": "__hash", "size": "__size"})
    same = docs["doc_id"].eqNullSafe(keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__hash"]) & F.octet_length(docs["text"]).eqNullSafe(keys["__size"])
    return docs.join(keys, same, how).drop("__id", "__hash", "__size")


def one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (doc_id, hash, size, times) name, one for each; ``times``: how many rows a key has.

    Rows whose key is unique are joined and pass as they are. Of the others, which are few or copies of each other, one
    is picked by an aggregate, which keeps one row a task before it shuffles.
    """
    keys = materialise(keys, "keys")
    out = same_text(docs, keys.filter("times = 1").drop("times"), "left_semi")
    if keys.filter("times > 1").isEmpty():
        return out
    again = same_text(docs, keys.filter("times > 1").drop("times"), "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    again = again.groupBy("doc_id", *text_key()).agg(F.first(whole).alias("__row")).select("__row.*")
    return out.union(again)


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` written out over as many files as there are cores, if it is read in fewer parts than that; else as it is.

    A table of a few large row groups keeps most cores idle, and several passes over it are then slower than one copy.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else materialise(docs.repartition(cores), "spread")


#: Bytes of text that a labelled sample has at most, about, and those of one of its texts.
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 48 << 20, 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int, max_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most ``max_rows`` texts, about ``max_bytes`` together, and their labels, among the labelled rows that ``learn`` allows.

    All labelled rows are counted first, and each is taken with the same chance by a hash of its doc_id, so the sample is
    spread over the whole table however large it is; texts above ``SAMPLE_TEXT_BYTES`` are not taken. An id with both
    labels counts as 1. The texts come to the driver, where the model is fitted.
    """
    known = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    if n > max_rows:
        known = known.filter(place < int(0.95 * max_rows / n * (1 << 30)))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # at most max_rows ids and labels
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), "doc_id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < int(max_bytes / size * (1 << 30)))
    held = rows.orderBy("doc_id", "text").limit(max_rows).toArrow()
    return held.column("text").combine_chunks().to_pylist(), held.column("y").to_numpy()
