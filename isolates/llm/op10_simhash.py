"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Fingerprints of all texts are computed in Arrow tasks. Distinct fingerprints are dealt to buckets by shared
bit blocks: of ``radius + shared`` blocks, two fingerprints within ``radius`` bits agree on ``shared`` at
least, so every linked pair meets in some bucket. A bucket is one tile, or, when it is large, as many tiles
as keep each within ``tile`` rows; tiles are made of rows of one bit count, and a pair of tiles is formed
only if their bit counts differ by ``radius`` at most. A tile pair is compared whole in numpy, and links are
reduced to a spanning forest of the pair, so that a dense group never emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import LOWER_TABLE, NOT_SPACE, flat, slices, spaced, spans
from isolates.operators.components import connected_components
from isolates.session import materialise, read_table

BITS = 64
SEED = 42
#: Bits in which linked fingerprints differ at most, and words of a shingle.
RADIUS, WIDTH = 4, 4
#: Rows that one side of a tile pair has at most, and rows that are compared at once in numpy.
TILE = 4096
BLOCK = 512
#: From this many distinct fingerprints on, buckets share two bit blocks instead of one.
MANY = 1 << 26

#: For each byte value, its bits as eight counters of a byte each.
_LANES = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One fingerprint a text from the hashes of its shingles; ``first`` has where each text's hashes begin, and their number."""
    counts = np.diff(first)
    out = np.zeros((len(counts), BITS), np.int64)
    if len(hashes):
        owner = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(hashes)) - first[:-1][owner]
        cut = np.flatnonzero(within % 255 == 0)
        sums = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], cut, axis=0).view(np.uint8)
        head = np.flatnonzero(within[cut] == 0)
        out[owner[cut[head]]] = np.add.reduceat(sums, head, axis=0, dtype=np.int64)
    return np.packbits(out * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of each text, in order, and where each text's begin."""
    data, offsets = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    joined, starts, ends = spaced(data, starts, ends)
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(words)), shingles)
    at = first[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    last = np.minimum(at + width, first[1:][owner]) - 1
    digest = xxhash.xxh64_intdigest
    out = [digest(joined[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist())]
    return np.array(out, np.uint64), begin


def with_fingerprint(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            fp = fingerprints(*shingle_hashes(batch.column("t"), width))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def forest(fp: np.ndarray, pop: np.ndarray, radius: int, left: np.ndarray | None = None) -> np.ndarray:
    """For each row the row that stands for its linked group. ``left``: which side each row is on, if only pairs across count."""
    order = np.argsort(pop, kind="stable")
    x, pop = fp[order], pop[order]
    label = np.arange(len(x))
    for i in range(0, len(x), BLOCK):
        a = x[i : i + BLOCK]
        for j in range(i, len(x), BLOCK):
            if pop[j] - pop[min(i + BLOCK, len(x)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ x[None, j : j + BLOCK]) <= radius
            if left is not None:
                near &= left[order][i : i + BLOCK, None] != left[order][None, j : j + BLOCK]
            for row in np.flatnonzero(near.any(axis=1)):
                met = np.append(label[j : j + BLOCK][near[row]], label[i + row])
                low = met.min()
                for other in np.unique(met[met != low]):
                    label[label == other] = low
    out = np.empty(len(x), np.int64)
    out[order] = order[label]
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by (g, g2), and where each group begins; a group's rows are at most two tiles."""

    def begins(table: pa.Table) -> np.ndarray:
        g, g2 = table.column("g").to_numpy(), table.column("g2").to_numpy()
        return np.append(0, np.flatnonzero((np.diff(g) != 0) | (np.diff(g2) != 0)) + 1)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(held[0].column(c)[0] == batch.column(c)[-1] for c in ("g", "g2")):
            continue
        table = pa.Table.from_batches(held)
        cut = begins(table)
        yield table.slice(0, cut[-1]), cut
        held = table.slice(cut[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(begins(table), table.num_rows)


def _compare(radius: int):
    """Arrow function over rows (g, g2, side, fp, rep) sorted by the first two: a forest of links (src, dst) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in groups(batches):
            side, fp, rep = (table.column(c).to_numpy() for c in ("side", "fp", "rep"))
            fp = fp.view(np.uint64)
            pop = np.bitwise_count(fp).astype(np.int64)
            src, dst = [], []
            for k in np.flatnonzero(np.diff(cut) > 1):
                s = slice(cut[k], cut[k + 1])
                root = forest(fp[s], pop[s], radius, None if side[cut[k]] == 2 else side[s])
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    src.append(rep[s][moved])
                    dst.append(rep[s][root[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return run


def bit_blocks(blocks: int) -> list[int]:
    """Masks that part 64 bits into ``blocks`` runs, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [m - (1 << BITS) if (m := ((1 << b) - 1) ^ ((1 << a) - 1)) >> 63 else m for a, b in zip(edges, edges[1:])]


def tile_pairs(rows: DataFrame, reach: int, tile: int) -> DataFrame:
    """``rows`` (bucket, p, key, ...) once for each tile pair that they are part of, with the pair (``g``, ``g2``) and their side.

    A pair is named by 128 bits, two hashes with seeds of their own.

    A bucket of at most ``tile`` rows is one tile (side 2: compared within). A larger one has tiles of one value of
    ``p`` each, parted by ``key`` where that has too many rows, and a pair of tiles for values ``reach`` apart at most.
    """
    held = rows.groupBy("bucket", "p").agg(F.count("*").alias("n"))
    large = (
        held.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("p", F.ceil(F.col("n") / tile).cast("int")))).alias("parts"))
        .filter(F.col("n") > tile)
        .select("bucket", "parts")
    )
    own = F.col("parts")[F.col("p")]
    keyed = rows.join(large, "bucket", "left").withColumn("s", F.when(own.isNotNull(), F.pmod("key", own)).cast("int"))

    def others(q, left):
        mine = F.struct(F.col("p"), F.col("s"))

        def pair(t):
            other = F.struct(q.alias("p"), t.alias("s"))
            side = F.when((q == F.col("p")) & (t == F.col("s")), 2).otherwise(0 if left else 1)
            names = ["p", "s", q, t] if left else [q, t, "p", "s"]
            pair = F.struct(F.xxhash64("bucket", *names).alias("g"), F.xxhash64(F.lit("g2"), "bucket", *names).alias("g2"), side.alias("side"))
            return F.when(other >= mine if left else other < mine, pair)

        parts = F.coalesce(F.col("parts")[q], F.lit(0))
        return F.when(parts > 0, F.transform(F.sequence(F.lit(0), parts - 1), pair)).otherwise(F.array())

    near = F.flatten(
        F.concat(
            F.transform(F.sequence(F.col("p"), F.col("p") + reach), lambda q: others(q, True)),
            F.transform(F.sequence(F.col("p") - reach, F.col("p")), lambda q: others(q, False)),
        )
    )
    alone = F.array(F.struct(F.xxhash64("bucket").alias("g"), F.xxhash64(F.lit("g2"), "bucket").alias("g2"), F.lit(2).alias("side")))
    rest = [c for c in rows.columns if c not in ("bucket", "p", "key")]
    placed = keyed.select(*rest, F.explode(F.when(F.col("parts").isNull(), alone).otherwise(F.array_compact(near))).alias("x"))
    return placed.select("x.g", "x.g2", "x.side", *rest)


def tile_rows(nodes: DataFrame, radius: int, shared: int, tile: int = TILE) -> DataFrame:
    """Rows (g, g2, side, fp, rep): each fingerprint once for each tile pair of the buckets that it lies in."""
    keys = []
    for i, chosen in enumerate(combinations(bit_blocks(radius + shared), shared)):
        mask = 0
        for m in chosen:
            mask |= m
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))))
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket"))
    return tile_pairs(keyed.withColumns({"p": F.bit_count("fp"), "key": F.xxhash64("fp")}), radius, tile)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, shared: int | None = None) -> DataFrame:
    """(src, dst): links that join the same ``nodes`` (fp, rep; each fp once) as all pairs within ``radius`` bits do."""
    if shared is None:
        shared = 1 if nodes.count() < MANY else 2
    rows = tile_rows(nodes, radius, shared, tile)
    rows = rows.repartition("g", "g2").sortWithinPartitions("g", "g2")
    return rows.mapInArrow(_compare(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, tile: int = TILE, shared: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): every row of ``docs`` with its class of linked fingerprints.

    Texts without words, null ones too, have fingerprint zero and are linked as any other. Copies share one
    fingerprint and are compared once. A null doc_id stands for no document in the classes and gets a null
    component only if no row with an id shares its fingerprint. Repeated rows stay; an empty table gives none.
    Other columns are ignored. ``shared``: bit blocks that a bucket has in common; None takes 1, or 2 for very
    many fingerprints. The result does not depend on it.
    """
    marked = materialise(with_fingerprint(docs, width), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    known = nodes.filter(F.col("rep").isNotNull())
    found = connected_components(fingerprint_links(known, radius, tile, shared))
    classes = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
