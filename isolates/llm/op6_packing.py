"""Packing of token sequences by shortest pack first over the histogram of lengths.

Texts are tokenized once, in Arrow tasks, and cut into pieces of at most ``size`` ids. The driver sees only the
histogram of piece lengths, at most ``size`` numbers: lengths are placed longest first, each on the pack with the
most room, and identical packs are handled together as one pattern with a count. The placements become rank ranges
by length, and pieces get theirs by their rank among the pieces of their length. Ranks come from counts by hash
bucket, so no task holds all pieces of one length.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.llm.text import slices
from isolates.session import materialise, read_table

SIZE = 2048
END_ID = 1
#: Pieces that one rank bucket should hold, and the bounds of the number of buckets.
BUCKET_ROWS = 200_000
MIN_BUCKETS, MAX_BUCKETS = 32, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """Text to ids by the byte-level vocabulary at ``path`` (ranks) and the added tokens, read once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    names = {content for content, _ in added}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))

    def encode(text: str) -> list[int]:
        # the file's tokenizer cuts a text at each added token; encode_ordinary would cut the token itself into pieces
        if any(name in text for name in names):
            return encoding.encode(text, allowed_special=names, disallowed_special=())
        return encoding.encode_ordinary(text)

    return encode


def public_vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Ranks of the public 50k byte-level vocabulary, its split pattern, and the added tokens that its tokenizer file lists."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("an added token is not matched as it stands")
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added)


def pieces(docs: DataFrame, vocabulary: tuple | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: its ids and the end id, cut every ``size`` ids; ``with_ids`` adds them as ``ids``."""
    named = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*named)
        for batch in slices(batches):
            rows: list[tuple] = []
            kept = []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(doc_ids, batch.column("text").to_pylist()):
                ids = array("I", encode(text)) if text else array("I")
                ids.append(END_ID)
                for a in range(0, len(ids), size):
                    piece = ids[a : a + size]
                    rows.append((doc, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        kept.append(piece.tolist())
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def place(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, number, first sequence, offset) of all pieces, shortest pack first.

    A bundle (room, first sequence, count) stands for ``count`` packs of one pattern. Equal pieces go to a bundle
    together; if they are fewer than its packs, it is parted.
    """
    out, open_packs, sequences = [], [], 0
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            if open_packs and -open_packs[0][0] >= length:
                room, first, count = heapq.heappop(open_packs)
                room = -room
            else:
                room, first, count = size, sequences, n
                sequences += n
            used = min(n, count)
            out.append((length, rank, used, first, size - room))
            if room > length:
                heapq.heappush(open_packs, (length - room, first, used))
            if used < count:
                heapq.heappush(open_packs, (-room, first + used, count - used))
            rank += used
            n -= used
    return out


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (as :func:`pieces` gives them, written already) with sequence_id and offset."""
    spark = parts.sparkSession
    held = parts.groupBy("length").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in held)
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, total // BUCKET_ROWS))
    placed = place({r["length"]: r["n"] for r in held}, size)
    steps = [np.array(c, np.int64) for c in zip(*placed)] if placed else [np.zeros(0, np.int64)] * 5
    # a few ranges for each length, whatever the number of pieces
    shared = spark.sparkContext.broadcast(steps)

    keyed = parts.withColumn("b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "b").agg(F.count("*").alias("n"))
    counts = counts.select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("length", "b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(counts, ["length", "b"]).withColumn("rank", (F.col("first") + F.col("r")).cast("long")).drop("b", "r", "first")
    ranked = ranked.select(*parts.columns, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, offset = shared.value
        key = length * -(1 << 44) + rank  # placements run from long to short
        for batch in batches:
            r = batch.column("rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() * -(1 << 44) + r, "right") - 1
            out = batch.drop_columns(["rank"])
            columns = [*out.columns, pa.array(first[at] + r - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*out.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: tuple | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every text in one piece of one sequence.

    Null and empty texts are one piece with the end id alone. Long texts are cut every ``size`` ids. Repeated rows and
    ties are packed each for itself, which of equal pieces goes where is arbitrary. A null doc_id stays null. Other
    columns are ignored; an empty table gives no rows.
    """
    return pack(materialise(pieces(docs, vocabulary, size), "pieces"), size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
