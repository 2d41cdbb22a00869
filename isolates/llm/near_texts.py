"""Near-duplicate texts by SimHash, and by the similarity of their shingle sets where fingerprints lie too far apart.

Two texts are near if their sets of word shingles have a Jaccard similarity of at least ``similarity``. First come the
links of :mod:`op10_simhash`: all fingerprints within its radius, by its tiles. Their classes are candidates. A
similarity of 0.8 lies near 10 of 64 bits, though, so pairs of different classes are looked for as follows. Each set has
least values under several hash orders, two of which make a band; texts with a band in common share a bucket. Sets at a
similarity of 0.8 agree on a band with a chance of 0.64, so that they miss each other in all 24 bands once in 4e10
pairs, more alike ones less often. A bucket whose texts are all linked to one by fingerprints goes. Within the others sets are compared by parity maps: each shingle flips one bit,
chosen by its hash, so two maps differ in at most as many bits as the sets have shingles that are not common. Tiles
hold texts whose numbers of shingles lie in one class, only classes that the similarity allows are paired, and a tile
pair is compared whole, by exclusive-or and bit counts. Pairs that differ in more bits than the similarity leaves room
for are ruled out for certain, the classes of the rest are candidates. Within each, the shingle sets themselves are
then compared, exactly, by tile pairs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolates.llm.op10_simhash import BLOCK, fingerprint_links, fingerprints, groups, shingle_hashes, tile_pairs
from isolates.llm.op10_simhash import WIDTH as PRINT_WIDTH
from isolates.llm.text import one_of_each, same_text, slices, text_key
from isolates.operators.components import connected_components
from isolates.session import discard, materialise

WIDTH, SIMILARITY = 5, 0.8
#: Bands of a text, each of two least values.
BANDS = 24
#: Bits of a parity map: the least power of two from here on that leaves unlike sets of that size far beyond the bound.
MIN_BITS = 256
#: Rows of a tile of parity maps and of one of shingle sets.
TILE, SET_TILE = 16_384, 512


def most_apart(similarity: float) -> float:
    """Shingles that are not common, as a share of both sets' sizes together, at most: 1/9 for a similarity of 0.8."""
    return (1 - similarity) / (1 + similarity)


def map_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity map of sets of ``n`` shingles: unlike sets differ in near half of them, five deviations over the bound."""
    bits = np.full(len(n), MIN_BITS, np.int64)
    while (narrow := bits - 5 * np.sqrt(bits) < 4 / 9 * n).any():
        bits[narrow] *= 2
    return bits


def parity_maps(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """The parity map of each set of hashes, as bytes; folding a map's halves by exclusive-or gives the one of half the bits."""
    n = np.diff(first)
    bits = map_bits(n)
    edges = np.append(0, np.cumsum(bits))
    at = np.repeat(edges[:-1], n) + (h & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    flipped = np.packbits(np.bincount(at, minlength=edges[-1]).astype(np.uint8) & 1, bitorder="little")
    offsets = pa.py_buffer((edges // 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(flipped.tobytes())])


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin."""
    h, first = shingle_hashes(column, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(first)))


_ORDERS = np.random.default_rng(11).integers(1, 1 << 63, 2 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bands of each set of hashes; an empty set has none."""
    some = np.diff(first) > 0
    begin, keys = first[:-1][some], []
    with np.errstate(over="ignore"):
        for i in range(BANDS if len(begin) else 0):
            one, two = (np.minimum.reduceat(h * _ORDERS[j], begin) for j in (2 * i, 2 * i + 1))
            key = (one ^ (two >> np.uint64(31)) ^ (two << np.uint64(33))) * _ORDERS[i] + np.uint64(i)
            keys.append(key ^ (key >> np.uint64(29)))
    edges = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
    values = np.stack(keys, axis=1).ravel().view(np.int64) if keys else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


def marked_texts(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, size, bits, n, sig, bands, fp): a row's identity, parity map, number of shingles, a sum over the set, its bands, its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, first = shingle_sets(batch.column("text"), width)
            mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
            sums = pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
            own = batch.select(["doc_id", "hash", "size"]).columns
            fp = pa.array(fingerprints(*shingle_hashes(batch.column("text"), PRINT_WIDTH)).view(np.int64))
            columns = [*own, parity_maps(h, first), pa.array(np.diff(first).astype(np.int32)), sums, band_keys(h, first), fp]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "size", "bits", "n", "sig", "bands", "fp"])

    made = "doc_id long, hash long, size int, bits binary, n int, sig long, bands array<long>, fp long"
    return docs.select("doc_id", "text", *text_key()).mapInArrow(run, made)


def fingerprint_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst): links that join the ``nodes`` (rep, fps) as all fingerprints within the radius of op10 do."""
    prints = nodes.select("rep", F.explode("fps").alias("fp"))
    first = materialise(prints.groupBy("fp").agg(F.min("rep").alias("rep")), "prints")
    same = prints.join(first.withColumnRenamed("rep", "dst"), "fp").filter("rep <> dst").select(F.col("rep").alias("src"), "dst")
    return fingerprint_links(first).union(same)


def spanning(near, size: int) -> np.ndarray:
    """For each of ``size`` rows the row that stands for its group; ``near(i, j)`` gives a matrix of links of two blocks, or None."""
    label = np.arange(size)
    for i in range(0, size, BLOCK):
        for j in range(i, size, BLOCK):
            linked = near(slice(i, i + BLOCK), slice(j, j + BLOCK))
            if linked is None:
                continue
            for row in np.flatnonzero(linked.any(axis=1)):
                met = np.append(label[j : j + BLOCK][linked[row]], label[i + row])
                low = met.min()
                for other in np.unique(met[met != low]):
                    label[label == other] = low
    return label


def _links(near_of):
    """Arrow function over rows sorted by g: a spanning forest (src, dst) of each group, by ``near_of(table)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in groups(batches):
            for k in np.flatnonzero(np.diff(cut) > 1):
                part = table.slice(cut[k], cut[k + 1] - cut[k])
                part = part.take(np.argsort(part.column("n").to_numpy(), kind="stable"))
                label = spanning(near_of(part), part.num_rows)
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    rep = part.column("rep").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["src", "dst"])

    return run


def _across(part: pa.Table):
    """Whether two blocks' rows are on different sides of the tile pair; all are, within one tile."""
    side = part.column("side").to_numpy()
    return (lambda a, b: True) if side[0] == 2 else (lambda a, b: side[a, None] != side[None, b])


def _by_bits(similarity: float):
    def near_of(part: pa.Table):
        n, across = part.column("n").to_numpy().astype(np.int64), _across(part)
        maps = [np.frombuffer(x, np.uint64) for x in part.column("bits").to_pylist()]
        words = np.array([len(x) for x in maps])
        made: dict[tuple[int, int], np.ndarray] = {}

        def folded(rows, width):
            """The maps of a block, a word a row, all folded to ``width`` words."""
            if (rows.start, width) not in made:
                out = [np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) if len(x) > width else x for x in maps[rows]]
                made[rows.start, width] = np.ascontiguousarray(np.stack(out).T)
            return made[rows.start, width]

        def near(a, b):
            if n[a][-1] < similarity * n[b][0]:
                return None
            width = int(min(words[a].min(), words[b].min()))
            x, y = folded(a, width), folded(b, width)
            far = np.zeros((x.shape[1], y.shape[1]), np.uint16 if width < 1024 else np.uint32)
            for i in range(width):
                far += np.bitwise_count(x[i][:, None] ^ y[i][None, :])
            most = most_apart(similarity) * (n[a, None] + n[None, b]) + 1e-6
            linked = (far <= most) & (np.minimum(n[a, None], n[None, b]) >= similarity * np.maximum(n[a, None], n[None, b]) - 1e-6)
            return linked & across(a, b) if linked.any() else None

        return near

    return near_of


def _by_sets(similarity: float):
    def near_of(part: pa.Table):
        n, across = part.column("n").to_numpy().astype(np.int64), _across(part)
        sets = part.column("shingles").combine_chunks()
        value, row = sets.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        code, times = np.unique(value, return_inverse=True, return_counts=True)[1:]
        often = times[code] > 1  # a shingle of one row alone is in no intersection
        kept, code = np.unique(code[often], return_inverse=True)
        row = row[often]

        def near(a, b):
            both = np.zeros((len(n[a]), len(n[b])), np.float32)
            for c in range(0, len(kept), 4096):  # shingles in turn, so that the matrices stay small
                x, y = np.zeros((len(n[a]), 4096), np.float32), np.zeros((len(n[b]), 4096), np.float32)
                for m, s in ((x, a), (y, b)):
                    on = np.flatnonzero((row >= s.start) & (row < s.stop) & (code >= c) & (code < c + 4096))
                    m[row[on] - s.start, code[on] - c] = 1
                both += x @ y.T
            linked = both >= similarity * (n[a, None] + n[None, b] - both) - 1e-6
            return linked & across(a, b)

        return near

    return near_of


def _classes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, hash, size, kept): every row of ``docs`` by its identity, and the identity (none, doc_id, hash, size) that its class keeps.

    A null id comes after all others. Nodes are shingle sets, with numbers of their own, so an id that stands on several
    texts joins nothing.
    """
    marked = materialise(marked_texts(docs, width), "marked")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "size")
    nodes = marked.groupBy("bits", "n", "sig").agg(F.min(own).alias("own"), F.min("bands").alias("bands"), F.collect_set("fp").alias("fps"))
    nodes = materialise(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    # neighbouring classes of sizes, a factor of the similarity wide each
    size_class = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / -math.log(similarity)).cast("int")
    linked = materialise(fingerprint_edges(nodes), "linked")
    # texts with one least neighbour are linked by fingerprints
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.least("src", "dst").alias("low")), F.struct(F.col("dst").alias("node"), F.least("src", "dst").alias("low"))))
    near = linked.select(ends.alias("x")).select("x.*").groupBy("node").agg(F.min("low").alias("low"))
    placed = nodes.join(near, nodes["rep"] == near["node"], "left").select("sig", "n", "bands", F.coalesce("low", "rep").alias("near"))
    banded = placed.select("sig", "n", "near", F.explode("bands").alias("bucket"))
    # most buckets hold one text or only texts that fingerprints link, and go before maps are brought in
    several = banded.groupBy("bucket").agg(F.min("near").alias("low"), F.max("near").alias("high")).filter("low < high").select("bucket")
    shared = banded.drop("near").join(several, "bucket")
    some = shared.join(nodes.select("sig", "n", "bits", "rep"), ["sig", "n"])
    some = some.select("bucket", size_class.alias("p"), F.xxhash64("sig").alias("key"), "bits", "n", "rep")
    buckets = materialise(some, "buckets")
    rows = tile_pairs(buckets, 1, TILE).repartition("g", "g2").sortWithinPartitions("g", "g2")
    candidates = rows.mapInArrow(_links(_by_bits(similarity)), "src long, dst long")
    coarse = materialise(connected_components(candidates.union(linked)), "coarse")
    discard(buckets)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, first = shingle_sets(batch.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("rep"), lists], ["bucket", "rep", "shingles"])

    members = nodes.join(coarse, nodes["rep"] == coarse["node"]).select("component", "rep", "own.doc_id", "own.hash", "own.size")
    texts = same_text(docs.select("doc_id", "text"), members, "inner").select("component", "rep", "text")
    held = materialise(texts.mapInArrow(sets, "bucket long, rep long, shingles array<long>"), "sets")
    held = held.withColumn("n", F.size("shingles")).withColumns({"p": size_class, "key": F.xxhash64("rep")})
    rows = tile_pairs(held.select("bucket", "p", "key", "n", "rep", "shingles"), 1, SET_TILE).repartition("g", "g2").sortWithinPartitions("g", "g2")
    found = connected_components(rows.mapInArrow(_links(_by_sets(similarity)), "src long, dst long"))
    labels = nodes.join(found, nodes["rep"] == found["node"], "left").select("bits", "n", "sig", "own", F.coalesce("component", "rep").alias("label"))
    kept = labels.join(labels.groupBy("label").agg(F.min("own").alias("kept")), "label").select("bits", "n", "sig", "kept")
    return marked.join(kept, ["bits", "n", "sig"]).select("doc_id", "hash", "size", "kept")


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kept_id) for every row of ``docs``: the lowest id of its class of near texts.

    Texts of fewer words than a shingle are one shingle; texts without words, null ones too, are all alike. Rows that
    repeat an id with another text are documents of their own. A null id takes part and is kept only where no row of the
    class has an id. Other columns are ignored, an empty table gives no rows.
    """
    return _classes(docs, width, similarity).select("doc_id", F.col("kept.doc_id").alias("kept_id"))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, all columns kept: the one with the lowest id, null ids last, then by its text's hash.

    Of rows that repeat id and text one stays. Texts without words, null ones too, are one class. Long texts are compared
    whole; an empty table stays empty.
    """
    keys = _classes(docs, width, similarity).filter("doc_id <=> kept.doc_id and hash <=> kept.hash and size <=> kept.size")
    return one_of_each(docs, keys.groupBy("doc_id", "hash", "size").agg(F.count("*").alias("times")))
