"""Benchmark decontamination by Wu-Manber search for many strings at once.

Every window of ``WINDOW`` words of a benchmark item is a pattern: its words with one space after each and one
before the first. Texts are brought to the same form. A cursor in each text reads the ``BLOCK`` bytes that end where
the shortest pattern would end; a shift table of hashed blocks says how far it may jump; where the shift is zero a
suffix-hash bucket gives the patterns to compare byte for byte. Cursors of all texts of a slice move together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import ALNUM, LOWER_TABLE, flat, slices, spaced, spans
from isolates.session import materialise, read_table

WINDOW = 10
#: Bytes of a block, and bits of the hashed shift table.
BLOCK, BITS = 8, 20
#: Lengths at which patterns are parted: each class has its own tables, so that one short pattern does not shorten all jumps.
CLASSES = (3, 12, 24, 40, 64)
#: Bytes of benchmark text that are searched for at once; more is searched for in several passes. A word adds a window of
#: ten words, so a worker's tables take some 25 times these bytes.
MAX_PATTERN_BYTES = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts, each followed by a space, after one leading space; where they lie; first word of each text."""
    data, offsets = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
    starts, ends, first = spans(data, offsets, ALNUM)
    joined, s, e = spaced(data, starts, ends)
    return b" " + joined, s + 1, e + 1, first


@dataclass
class Tables:
    """One class of patterns: least length, shift by hashed block, and patterns sorted by the hash of their least-length prefix's last block."""

    least: int
    block: int
    shift: np.ndarray
    key: np.ndarray
    start: np.ndarray
    length: np.ndarray
    number: np.ndarray


@dataclass
class Patterns:
    data: bytes
    n_words: np.ndarray
    items: list[tuple[str, ...]]
    tables: list[Tables]


def blocks_at(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` bytes (8 at most) that begin at each place."""
    wide = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))[at]
    return (wide << np.uint64(64 - 8 * block)) * MIX


def compile_patterns(items: list[tuple[str, str]]) -> Patterns:
    """Tables for all windows of (item_id, text)."""
    found: dict[bytes, set[str]] = {}
    if items:
        joined, s, e, first = words_of(pa.array([t for _, t in items], pa.string()))
        for (item, _), a, b in zip(items, first, first[1:]):
            width = min(WINDOW, b - a)
            for i in range(a, b - width + 1 if width else a):
                found.setdefault(joined[s[i] - 1 : e[i + width - 1] + 1], set()).add(item)
    texts = sorted(found)
    data = b"".join(texts) + bytes(8)
    raw = np.frombuffer(data, np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    start = np.append(0, np.cumsum(length))[:-1]
    tables = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
        chosen = np.flatnonzero((length >= low) & (length < high))
        if not len(chosen):
            continue
        least = int(length[chosen].min())
        block = min(BLOCK, least)
        shift = np.full(1 << BITS, least - block + 1, np.int32)
        for back in range(least - block, -1, -1):  # distance of a block from the end of the least length
            h = blocks_at(raw, start[chosen] + least - block - back, block) >> np.uint64(64 - BITS)
            shift[h.astype(np.int64)] = np.minimum(shift[h.astype(np.int64)], back)
        key = blocks_at(raw, start[chosen] + least - block, block)
        order = np.argsort(key, kind="stable")
        tables.append(Tables(least, block, shift, key[order], start[chosen][order], length[chosen][order], chosen[order]))
    n_words = np.array([t.count(b" ") - 1 for t in texts], np.int64)
    return Patterns(data, n_words, [tuple(sorted(found[t])) for t in texts], tables)


def search(patterns: Patterns, joined: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (place, pattern) at which a pattern stands within [begin, end) of some text; texts share their edge space."""
    places, numbers = [], []
    data = np.frombuffer(joined + bytes(8), np.uint8)
    for t in patterns.tables:
        # long texts get many cursors, each for the places of one stretch
        step = 2048
        n = np.maximum(0, -(-(end - begin - t.least + 1) // step))
        owner = np.repeat(np.arange(len(n)), n)
        at = begin[owner] + (np.arange(len(owner)) - np.append(0, np.cumsum(n))[:-1][owner]) * step
        stop, limit = np.minimum(at + step, end[owner] - t.least + 1), end[owner]
        while len(at):
            h = blocks_at(data, at + (t.least - t.block), t.block)
            jump = t.shift[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                lo, hi = np.searchsorted(t.key, h[hit], "left"), np.searchsorted(t.key, h[hit], "right")
                for i, a, b in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    p = int(at[i])
                    for c in range(a, b):
                        size, s = int(t.length[c]), int(t.start[c])
                        if p + size <= limit[i] and joined[p : p + size] == patterns.data[s : s + size]:
                            places.append(p)
                            numbers.append(int(t.number[c]))
                jump[hit] = 1
            at = at + jump
            keep = at < stop
            at, stop, limit = at[keep], stop[keep], limit[keep]
    return np.array(places, np.int64), np.array(numbers, np.int64)


def occurrences(patterns: Patterns, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[set[str]]]:
    """For each text its number of words, first and end words of all occurrences in turn, and the items that they come from."""
    joined, s, e, first = words_of(column)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    place, number = search(patterns, joined, s[first[:-1][full]] - 1, e[first[1:][full] - 1] + 1)
    word = np.searchsorted(s, place + 1)
    text = np.searchsorted(first, word, "right") - 1
    hits: list[list[int]] = [[] for _ in range(len(counts))]
    items: list[set[str]] = [set() for _ in range(len(counts))]
    for i, w, p in zip(text.tolist(), (word - first[text]).tolist(), number.tolist()):
        hits[i] += (w, w + int(patterns.n_words[p]))
        items[i].update(patterns.items[p])
    return counts, hits, items


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>"


def summed(ids: pa.Array, counts: np.ndarray, hits: list, items: list) -> pa.RecordBatch:
    """The result's rows from each text's occurrences and items."""
    n_hit = []
    for n, h in zip(counts.tolist(), hits):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, h[::2], 1)
        np.subtract.at(edge, h[1::2], 1)
        n_hit.append(int((np.cumsum(edge) > 0).sum()) if len(h) else 0)
    items = [sorted(set(x)) for x in items]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    columns = [ids, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "item_ids"])


@lru_cache(maxsize=4)
def _tables(number: int, holder) -> Patterns:
    return compile_patterns(holder.value)


def _compiled(shared) -> Patterns:
    """The tables of a broadcast set of items, made once in each worker."""
    return _tables(shared._id if hasattr(shared, "_id") else id(shared), shared)


def _parts(benchmark: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The items (item, text) with both, in parts of about ``max_bytes`` of text by a hash of each item; at least one part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items for k in range(parts)]


def _shared(part: DataFrame):
    """A part's items, broadcast."""
    return part.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])


def _occurrences_by_part(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(doc_id, hash, size, hits, items) of the texts that hold any window, a row a part; one part's tables exist at a time.

    What is found is written before the next part is broadcast. Only texts with a window are, so it is small.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    out = None
    for part in parts:
        shared = _shared(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = _compiled(shared)
            for batch in slices(batches):
                _, hits, items = occurrences(patterns, batch.column("text"))
                on = [i for i, x in enumerate(items) if x]
                kept = batch.select(["doc_id", "hash", "size"]).take(pa.array(on, pa.int64()))
                lists = [pa.array([hits[i] for i in on], pa.list_(pa.int32())), pa.array([sorted(items[i]) for i in on], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *lists], ["doc_id", "hash", "size", "hits", "items"])

        found = materialise(keyed.mapInArrow(run, "doc_id long, hash long, size int, hits array<int>, items array<string>"), "hits")
        shared.destroy()
        out = found if out is None else out.union(found)
    return out.distinct()


def without_contaminated(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` without the rows in which any window occurs; all columns stay.

    Rows with null or empty texts stay, rows that repeat go or stay together, an empty benchmark takes nothing out.
    """
    parts = _parts(benchmark, max_bytes)
    if len(parts) > 1:
        gone = _occurrences_by_part(docs, parts).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("size").alias("__size")).distinct()
        same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__hash"]) & (F.octet_length(docs["text"]) == gone["__size"])
        return docs.join(gone, same, "left_anti")
    shared = _shared(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _compiled(shared)
        for batch in slices(batches):
            yield batch.filter(pa.array([not x for x in occurrences(patterns, batch.column("text"))[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, item_ids) for every row of ``docs``.

    Null and empty texts have no words and hit nothing; a null or empty item has no window. Repeated rows and items
    are each treated alike; items with one text share its windows and tie on all counts. Other columns are ignored,
    and an empty table on either side is fine. The benchmark's size is summed first. Up to ``max_bytes`` the texts are
    read once, without a shuffle; beyond that the benchmark is parted by a hash of its items, each part is one pass
    that writes what it finds, and these few rows are joined to the texts' ids at the end.
    """
    parts = _parts(benchmark, max_bytes)
    if len(parts) == 1:
        shared = _shared(parts[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = _compiled(shared)
            for batch in slices(batches):
                yield summed(batch.column("doc_id"), *occurrences(patterns, batch.column("text")))

        return docs.select("doc_id", "text").mapInArrow(run, FOUND)
    found = _occurrences_by_part(docs, parts).groupBy("doc_id", "hash", "size")
    found = found.agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = np.diff(words_of(batch.column("text"))[3])
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "hash", "size"]).columns, pa.array(n, pa.int64())], ["doc_id", "hash", "size", "n"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    counted = keyed.mapInArrow(count, "doc_id long, hash long, size int, n long").alias("c")
    same = F.expr("c.doc_id <=> f.doc_id and c.hash = f.hash and c.size = f.size")
    both = counted.join(found.alias("f"), same, "left").select("c.doc_id", "c.n", "f.hits", "f.items")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = ([x or [] for x in batch.column(c).to_pylist()] for c in ("hits", "items"))
            yield summed(batch.column("doc_id"), batch.column("n").to_numpy(), hits, items)

    return both.mapInArrow(end, FOUND)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids").withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, text FROM documents),
cut AS (
  SELECT row, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item, LEAST(10, LEN(w)) AS n, ARRAY_TO_STRING(w[i : i + LEAST(10, LEN(w)) - 1], ' ') AS words
  FROM (SELECT item, w, UNNEST(range(1, LEN(w) - LEAST(10, LEN(w)) + 2)) AS i FROM item WHERE LEN(w) > 0)),
size AS (SELECT DISTINCT n FROM pattern),
place AS (
  SELECT row, n, i, ARRAY_TO_STRING(w[i : i + n - 1], ' ') AS words
  FROM (SELECT row, w, n, UNNEST(range(1, LEN(w) - n + 2)) AS i FROM cut, size WHERE LEN(w) >= n)),
met AS (SELECT row, i, p.n, item FROM place JOIN pattern p USING (n, words)),
hit AS (SELECT row, COUNT(DISTINCT k) AS n_hit FROM (SELECT row, UNNEST(range(i, i + n)) AS k FROM met) GROUP BY row),
of AS (SELECT row, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM met) GROUP BY row)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN hit USING (row) LEFT JOIN of USING (row)
"""
