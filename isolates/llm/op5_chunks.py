"""Substring dedup by content-defined chunks: a gear rolling hash over the bytes chooses where chunks end.

A word ends a chunk if its gear value (over the last 16 bytes) is the least among the words within ``REACH`` of
it. That rule looks at nearby bytes only, so an insertion changes the chunks around it and no others. From every chunk
on, the chunks that make up ``MIN_WORDS`` words or more are a window, which is digested as a whole; a window whose digest
stands earlier too is a repeated passage that truly stands there in one piece, and windows that overlap are joined. Only
digests are shuffled; the text stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.llm.text import NOT_SPACE, flat, one_of_each, same_text, slices, spaced, spans, text_key
from isolates.session import discard, materialise, read_table

#: Bytes that a gear value depends on, and words to each side that a chunk's last word must undercut.
WINDOW = 16
REACH = 3
#: A word longer than this is cut inside, where the gear value has five zero bits.
LONG_WORD = 128
#: Words that a window has in whole chunks, at least. A passage of 50 words has about 35 in whole chunks.
MIN_WORDS = 15

#: The gear table: one random number for each byte value, zero for the padding between texts.
GEAR = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
GEAR[0] = 0


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear value at each byte, by doubling the window; bytes of an earlier text never count."""
    n = len(offsets) - 1
    shift = np.repeat(np.arange(1, n + 1) * WINDOW, np.diff(offsets))
    padded = np.zeros(len(data) + n * WINDOW, np.uint64)
    place = np.arange(len(data)) + shift
    padded[place] = GEAR[data]
    width = 1
    while width < WINDOW:
        padded[width:] += padded[:-width] << np.uint64(width)
        width *= 2
    return (padded * np.uint64(0x9E3779B97F4A7C15))[place] >> np.uint64(8)


@dataclass
class Chunks:
    """For each chunk: row of its text, number within it, words before it and up to its end, first byte and end byte; all words, spaced."""

    row: np.ndarray
    number: np.ndarray
    before: np.ndarray
    upto: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    joined: bytes
    place: np.ndarray
    stop: np.ndarray

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """From which chunk to which each window goes; the last chunks of a text are too few for one."""
        last = np.searchsorted(self.upto, self.before + min_words)
        begin = np.flatnonzero(last < len(self.row))
        begin = begin[self.row[begin] == self.row[last[begin]]]
        return begin, last[begin]

    def digests(self, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits of each range of chunks, their words with one space between."""
        digest = xxhash.xxh3_128_digest
        joined = self.joined
        return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(self.place[begin].tolist(), self.stop[last].tolist())]), np.int64).reshape(-1, 2)


def chunked(column: pa.Array) -> Chunks:
    data, offsets = flat(column)
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return Chunks(*[np.zeros(0, np.int64)] * 6, b"", *[np.zeros(0, np.int64)] * 2)
    value = gear(data, offsets)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        inner = [s + 1 + np.flatnonzero((value[s : e - 1] & np.uint64(31) == 0) & (data[s + 1 : e] & 0xC0 != 0x80)) for s, e in zip(starts[long], ends[long])]
        cuts = np.concatenate(inner)
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    v = value[ends - 1]
    last = np.ones(len(v), bool)
    for d in range(1, REACH + 1):
        apart = owner[d:] != owner[:-d]
        last[d:] &= apart | (v[d:] < v[:-d])
        last[:-d] &= apart | (v[:-d] <= v[d:])
    last[first[1:][np.diff(first) > 0] - 1] = True
    end = np.flatnonzero(last)
    begin = np.append(0, end[:-1] + 1)
    joined, s, e = spaced(data, starts, ends)
    row = owner[end]
    number = np.arange(len(end)) - np.searchsorted(row, row)
    return Chunks(row, number, begin, end + 1, starts[begin] - offsets[row], ends[end] - offsets[row], joined, s[begin], e[end])


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, hash, chunks, words, one, two): the windows of every text, its identity, first and last chunk and word, and digest.

    ``chunks`` and ``words`` hold two numbers each, the first in the upper half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = chunked(batch.column("text"))
            begin, last = c.windows(min_words)
            if not len(begin):
                continue
            digest = c.digests(begin, last)
            zero = c.before[np.searchsorted(c.row, c.row[begin])]
            own = [batch.column(x).take(pa.array(c.row[begin])) for x in ("doc_id", "hash")]
            chunks, words = c.number[begin] << 32 | c.number[last], c.before[begin] - zero << 32 | c.upto[last] - zero
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (chunks, words, digest[:, 0], digest[:, 1]))], ["doc_id", "hash", "chunks", "words", "one", "two"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, hash long, chunks long, words long, one long, two long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = True) -> DataFrame:
    """(doc_id, text_hash, first_chunk, last_chunk, n_words, kept_in): passages whose text also stands in an earlier place.

    A window of whole chunks with ``min_words`` words or more stays where its text occurs first (lowest doc_id, null ids
    last, then the text's hash and the place); later ones are repeats. Repeats of one document that overlap or touch are
    joined to one passage, with the documents that keep its windows in ``kept_in`` (null ids are not listed). ``within``:
    whether repeats of a document's own text count. Null and empty texts have no chunks. A document is an id and a text:
    two texts under one id are compared like any others, rows that repeat both are one document. Other columns are
    ignored; an empty table gives no rows.
    """
    parts = materialise(windows(docs, min_words), "windows")
    often = parts.groupBy("one", "two").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    # most windows stand once and go before places are compared
    again = materialise(parts.join(often, ["one", "two"]), "repeats")
    discard(parts)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", F.shiftright("chunks", 32).alias("k"))
    held = again.withColumn("place", place)
    first = held.groupBy("one", "two").agg(F.min("place").alias("kept"))
    later = held.join(first, ["one", "two"]).filter(F.col("place") != F.col("kept"))
    if not within:
        later = later.filter(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("hash") == F.col("kept.hash"))))
    low = F.lit((1 << 32) - 1)
    later = later.select(
        "doc_id", "hash", "kept", F.col("place.k").alias("k"), F.col("chunks").bitwiseAND(low).alias("last"), F.shiftright("words", 32).alias("a"), F.col("words").bitwiseAND(low).alias("z")
    )
    in_doc = W.partitionBy("doc_id", "hash").orderBy("k", "last")
    so_far = F.max("last").over(in_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = later.withColumn("new", F.when(F.col("k") > so_far + 1, 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(in_doc))
    return runs.groupBy("doc_id", F.col("hash").alias("text_hash"), "run").agg(
        F.min("k").cast("int").alias("first_chunk"),
        F.max("last").cast("int").alias("last_chunk"),
        (F.max("z") - F.min("a")).cast("int").alias("n_words"),
        F.sort_array(F.collect_set("kept.doc_id")).alias("kept_in"),
    ).drop("run")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the passages' chunks, all columns kept; a text that loses every word becomes empty.

    A passage is cut from the text that it was found in, not from others under the same id. Of rows that repeat id and
    text one stays, whatever their length. Texts that hold no passage, null and empty ones too, are returned byte for
    byte; ``n_chars`` follows the text if there is such a column. An empty table stays empty.
    """
    names = docs.columns
    spots = passages.groupBy("doc_id", F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("first_chunk", "last_chunk")).alias("__cut"))
    times = docs.select("doc_id", *text_key()).groupBy("doc_id", "hash", "size").agg(F.count("*").alias("times")).filter("times > 1")
    times = materialise(times, "repeated_rows")
    if not times.isEmpty():
        rest = same_text(docs, times.drop("times"), "left_anti")
        docs = rest.union(one_of_each(docs, times))
    spots = spots.withColumnsRenamed({"doc_id": "__id", "hash": "__hash"})
    joined = docs.join(spots, docs["doc_id"].eqNullSafe(spots["__id"]) & (F.xxhash64(docs["text"]) == spots["__hash"]), "left").drop("__id", "__hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cuts = batch.column("__cut").to_pylist()
            texts = batch.column("text").to_pylist()
            held = [i for i, c in enumerate(cuts) if c and texts[i]]
            if held:
                c = chunked(batch.column("text").take(pa.array(held)))
                edge = np.searchsorted(c.row, np.arange(len(held) + 1))
                for n, i in enumerate(held):
                    gone = np.zeros(edge[n + 1] - edge[n], bool)
                    for cut in cuts[i]:
                        gone[cut["first_chunk"] : cut["last_chunk"] + 1] = True
                    raw, begin, end = texts[i].encode(), c.begin[edge[n] : edge[n + 1]], c.end[edge[n] : edge[n + 1]]
                    begin, end = np.append(begin, len(raw)), end
                    kept = [raw[: begin[0]]] + [raw[begin[m] : begin[m + 1]] for m in np.flatnonzero(~gone)]
                    texts[i] = b"".join(kept).decode() if not gone.all() else ""
            out = batch.drop_columns(["__cut"])
            at = names.index("text")
            new = pa.array(texts, out.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([new if c == at else x for c, x in enumerate(out.columns)], schema=out.schema)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that also stands earlier in the table, and the documents that keep it."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
