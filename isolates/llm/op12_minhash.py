"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets and star edges.

Each shingle is hashed once: some of its bits choose one of ``BINS`` bins, where the least hash stays. An empty bin takes the
value of another one, which a hash of (bin, attempt) chooses anew until it meets a bin that was not empty; so two sets
still agree in a bin with the chance of their similarity. ``ROWS`` bins make a band, and texts that share a band share a
bucket: pairs at a similarity of 0.85 miss each other in all bands once in 10^10. Every text of a bucket is linked to one
centre only, so a bucket of n texts has n - 1 candidate edges. Candidate classes are the components of these edges. In
each, the full shingle sets are compared by tiles (numpy matrix products), exactly, and the links that hold are reduced to
a spanning forest of each tile pair; the result is the components of these.

Texts with one shingle set are one node, however many copies there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.near_texts import _by_sets, _links, shingle_sets
from isolates.llm.op10_simhash import tile_pairs
from isolates.llm.text import slices
from isolates.operators.components import connected_components
from isolates.session import materialise, read_table

WIDTH, SIMILARITY = 5, 0.85
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Attempts of an empty bin that are drawn; later ones go from bin to bin.
DRAWN = 512
#: Rows of one side of a tile pair.
TILE = 512

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_DRAWS = np.random.default_rng(12).integers(0, BINS, (DRAWN, BINS))
_ODD = np.random.default_rng(13).integers(1, 1 << 63, ROWS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` least hashes for each set, densified; a row of an empty set stays empty."""
    n = len(first) - 1
    out = np.full((n, BINS), _EMPTY)
    mixed = _mixed(h)
    place = np.repeat(np.arange(n), np.diff(first)) * BINS + ((mixed >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(out.ravel(), place, mixed * _ODD[-1] >> np.uint64(1))
    held = out != _EMPTY
    row, bin_ = np.nonzero(~held & (np.diff(first) > 0)[:, None])
    for attempt in range(DRAWN + BINS):
        if not len(row):
            break
        donor = _DRAWS[attempt, bin_] if attempt < DRAWN else (bin_ + attempt - DRAWN + 1) % BINS
        found = held[row, donor]
        out[row[found], bin_[found]] = out[row[found], donor[found]]
        row, bin_ = row[~found], bin_[~found]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed((key ^ parts[:, :, i]) * _ODD[i])
    return key


def with_sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hash, digest, n, bands) for every row: the text's hash, 128 bits of its shingle set, the set's size and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, first = shingle_sets(batch.column("text"), width)
            n = np.diff(first)
            raw = h.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(first.tolist(), first[1:].tolist())]
            some = np.flatnonzero(n > 0)
            edges = np.append(0, np.cumsum((n > 0) * BANDS)).astype(np.int32)
            with np.errstate(over="ignore"):
                keys = np.concatenate([band_keys(sketches(h[first[a[0]] : first[a[-1] + 1]], first[np.append(a, a[-1] + 1)] - first[a[0]])).ravel() for a in _runs(some)] or [np.zeros(0, np.uint64)])
            bands = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.view(np.int64)))
            columns = [batch.column("doc_id"), batch.column("hash"), pa.array(digest, pa.binary()), pa.array(n.astype(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "digest", "n", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, hash long, digest binary, n long, bands array<long>")


def _runs(rows: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring rows, 4096 at most each."""
    out = []
    for part in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1) if len(rows) else []:
        out += [part[i : i + 4096] for i in range(0, len(part), 4096)]
    return out


def star_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst): for each bucket an edge from all of its ``nodes`` (id, bands) to one of them."""
    banded = nodes.select("id", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("last > centre").drop("last")
    return banded.join(centres, "bucket").filter("id <> centre").select(F.col("id").alias("src"), F.col("centre").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the lowest doc_id of its class of linked texts.

    Texts of fewer words than a shingle are one shingle. Null texts and those without words have an empty set, are
    linked with nothing and stand for themselves. Rows that repeat an id are documents of their own. A null doc_id takes
    part in links but is never the lowest: its component is null only if no row with an id is linked to it. Other
    columns are ignored; an empty table gives no rows.
    """
    marked = materialise(with_sketch(docs, width), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")).alias("first")
    nodes = marked.filter("n > 0").groupBy("digest", "n").agg(first, F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    coarse = materialise(connected_components(star_edges(nodes)), "coarse")

    members = nodes.join(coarse, nodes["id"] == coarse["node"]).select("id", "component", F.col("first.doc_id").alias("own"), F.col("first.hash").alias("own_hash"))
    keyed = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text"))
    texts = keyed.join(members, keyed["doc_id"].eqNullSafe(members["own"]) & (keyed["hash"] == members["own_hash"])).select("component", "id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, first = shingle_sets(batch.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), lists], ["bucket", "rep", "shingles"])

    held = materialise(texts.mapInArrow(sets, "bucket long, rep long, shingles array<long>"), "sets")
    held = held.withColumn("n", F.size("shingles"))
    # neighbouring classes of sizes, a factor of the similarity wide each
    size_class = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / -math.log(similarity)).cast("int")
    held = held.withColumns({"p": size_class, "key": F.xxhash64("rep")})
    rows = tile_pairs(held.select("bucket", "p", "key", "n", "rep", "shingles"), 1, TILE).repartition("g", "g2").sortWithinPartitions("g", "g2")
    links = rows.mapInArrow(_links(_by_sets(similarity)), "src long, dst long")
    found = connected_components(links)
    labels = nodes.join(found, nodes["id"] == found["node"], "left").select("digest", "n", F.coalesce("component", "id").alias("label"), F.col("first.doc_id").alias("own"))
    lowest = labels.groupBy("label").agg(F.min("own").alias("component_id"))
    classes = labels.join(lowest, "label").select("digest", "n", "component_id")
    linked = marked.filter("n > 0").join(classes, ["digest", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(marked.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its class at a similarity of 0.85."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT row, ARRAY_TO_STRING(w[i : i + 4], ' ') AS s
  FROM (SELECT row, w, UNNEST(range(1, GREATEST(LEN(w) - 3, 2))) AS i FROM d WHERE LEN(w) > 0)),
size AS (SELECT row, COUNT(*) AS n FROM grams GROUP BY row),
shared AS (SELECT a.row AS x, b.row AS y, COUNT(*) AS common FROM grams a JOIN grams b ON a.s = b.s AND a.row <> b.row GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN size p ON p.row = x JOIN size q ON q.row = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT row AS node, row AS seen FROM d UNION SELECT r.node, l.y FROM reach r JOIN link l ON l.x = r.seen),
lowest AS (SELECT node, MIN(doc_id) AS component_id FROM reach JOIN d ON d.row = seen GROUP BY node)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN size USING (row) JOIN lowest ON node = row
"""
