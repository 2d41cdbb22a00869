"""Species calls from nucleotide identity and marker positions, and identity from sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE
from isolates.session import ship_package

#: Bases of a sequence that are hashed at once.
STRETCH = 1 << 20


def genotype_markers(sites: DataFrame, markers: DataFrame, reads: int = 3) -> DataFrame:
    """(sample_id, marker_species, conflict): the species all of whose callable markers agree.

    ``markers``: species, chrom, pos, allele. A species is complete if at least one of its markers is callable and all
    callable ones carry its allele; with several complete species there is a conflict and no species.
    """
    met = sites.join(F.broadcast(markers), ["chrom", "pos"])
    agrees = E.major_allele() == F.col("allele")
    per = met.filter(E.acgt_depth() >= reads).groupBy("sample_id", "species").agg(F.bool_and(F.coalesce(agrees, F.lit(False))).alias("complete"))
    full = per.filter("complete").groupBy("sample_id").agg(F.count("*").alias("n"), F.min("species").alias("species"))
    return full.select("sample_id", F.when(F.col("n") == 1, F.col("species")).alias("marker_species"), (F.col("n") > 1).alias("conflict"))


def identify(matches: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """One row a sample: name, complex, ani, aligned_fraction, resolved, confidence and the ten best candidates.

    ``matches``: sample_id, name, complex (may be NULL), ani, aligned_fraction (may be NULL). Nothing under 95 % is
    named. A best match that aligns too little names its complex at most. Members of MTBC are always the complex. In
    MAC a species needs 99 % and a marker call that agrees. Elsewhere the best match is the species, with moderate
    confidence if rivals pass 95 % too or the aligned fraction is unknown.
    """
    order = W.partitionBy("sample_id").orderBy(F.desc_nulls_last("ani"), "name")
    ranked = matches.withColumn("i", F.row_number().over(order))
    top = ranked.groupBy("sample_id").agg(
        F.min_by(F.struct("name", "complex", "ani", "aligned_fraction"), "i").alias("best"),
        F.count_distinct(F.when(F.col("ani") >= VALUE["ani_species"], F.col("name"))).alias("passing"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 10, F.struct("i", "name", "ani")))), lambda x: F.struct(x["name"].alias("name"), x["ani"].alias("ani"))).alias("candidates"),
    )
    if markers is not None:
        top = top.join(markers.select("sample_id", "marker_species"), "sample_id", "left")
    else:
        top = top.withColumn("marker_species", F.lit(None).cast("string"))
    ani, aligned, group = F.col("best.ani"), F.col("best.aligned_fraction"), F.coalesce("best.complex", F.lit(""))
    known = F.coalesce(ani >= VALUE["ani_species"], F.lit(False))
    thin = F.coalesce(aligned < VALUE["ani_aligned"], F.lit(False))
    mac = (group == "MAC") & (ani >= VALUE["ani_mac"]) & (F.col("marker_species") == F.col("best.name"))
    resolved = known & ~thin & F.when(group == "MTBC", False).when(group == "MAC", F.coalesce(mac, F.lit(False))).otherwise(True)
    confidence = (
        F.when(~known, "none")
        .when(thin, "low")
        .when(group == "MTBC", F.when(aligned.isNull(), "moderate").otherwise("high"))
        .when(~resolved | (F.col("passing") > 1) | aligned.isNull(), "moderate")
        .otherwise("high")
    )
    name = F.when(~known, "unresolved").when(resolved, F.col("best.name")).when(group != "", group).otherwise("unresolved")
    return top.select(
        "sample_id", name.alias("name"), F.when(known, group).alias("complex"), ani.alias("ani"), aligned.alias("aligned_fraction"), resolved.alias("resolved"), confidence.alias("confidence"), "candidates"
    )


def choose_reference(samples: DataFrame, species: DataFrame, references: DataFrame, matches: DataFrame, least_ani: float = 80.0, mtbc: str = "H37Rv") -> DataFrame:
    """(sample_id, reference): the one asked for, else H37Rv for MTBC, else the called species' genome, else the best match of 80 % or more."""
    own = references.groupBy("name").agg(F.min("reference").alias("genome"))
    best = matches.filter(F.col("ani") >= least_ani).groupBy("sample_id").agg(F.max_by("reference", F.struct("ani", "reference")).alias("nearest"))
    out = samples.select("sample_id", F.col("reference").alias("asked")).join(species.select("sample_id", "name", "complex"), "sample_id", "left")
    out = out.join(own, "name", "left").join(best, "sample_id", "left")
    return out.select("sample_id", F.coalesce(F.nullif("asked", F.lit("")), F.when(F.col("complex") == "MTBC", mtbc), F.col("genome"), F.col("nearest")).alias("reference"))


def mixed(code: np.ndarray) -> np.ndarray:
    """63 bits of each k-mer's code, by the finalizer of splitmix64."""
    x = code.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = _CODE[list(b"acgt")] = range(4)


def kmer_hashes(seq: bytes, k: int) -> np.ndarray:
    """Hashes of the canonical k-mers of a sequence, in order, repeats included; those with other letters are left out."""
    base = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        here = base[i : i + n].astype(np.uint64) & np.uint64(3)
        forward = forward << np.uint64(2) | here
        back |= (np.uint64(3) - here) << np.uint64(2 * i)
    other = np.append(0, np.cumsum(base == 4))
    return mixed(np.minimum(forward, back)[other[k:] == other[:n]])


def sketches(sequences: DataFrame, k: int = 21, size: int = 1000, least: int = 1) -> DataFrame:
    """(id, hash): the ``size`` least hashes of each sequence's canonical k-mers (``k`` of 32 at most). ``sequences``: id, seq.

    An id may have any number of rows, as reads have. A task keeps no more than ``size`` hashes of an id from a batch
    before anything is shuffled, so what meets is sketches and not k-mers. ``least``: k-mers with fewer copies are left
    out, for reads, in which a k-mer that occurs once is an error as a rule; they are then counted before they are
    ranked. Ids without a k-mer have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for name, seq in zip(batch.column("id").to_pylist(), batch.column("seq").to_pylist()):
                raw = (seq or "").encode()
                for a in range(0, len(raw), STRETCH):
                    h = kmer_hashes(raw[a : a + STRETCH + k - 1], k)
                    found.setdefault(name, []).append(np.unique(h)[:size] if least == 1 else h)
            for name, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                if least == 1:
                    h, n = h[:size], n[:size]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["id", "hash", "n"])

    ship_package(sequences.sparkSession)
    if k > 32:
        raise ValueError(f"k is 32 at most; got {k}")
    parts = sequences.select(F.col("id").cast("string").alias("id"), "seq").filter("id is not null").mapInArrow(run, "id string, hash long, n long")
    kept = parts.groupBy("id", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least) if least > 1 else parts.select("id", "hash").distinct()
    # ranks above the size are dropped before the shuffle as well
    return kept.withColumn("i", F.row_number().over(W.partitionBy("id").orderBy("hash"))).filter(F.col("i") <= size).select("id", "hash")


def sketch_identity(queries: DataFrame, references: DataFrame, k: int = 21) -> DataFrame:
    """(query, reference, shared, jaccard, ani) of sketches that share a hash, by the published distance -ln(2j / (1 + j)) / k."""
    q = queries.select(F.col("id").alias("query"), "hash")
    r = references.select(F.col("id").alias("reference"), "hash")
    shared = q.join(r, "hash").groupBy("query", "reference").agg(F.count("*").alias("shared"))
    sizes = lambda df, name: df.groupBy(name).agg(F.count("*").alias(f"n_{name}"))
    out = shared.join(sizes(q, "query"), "query").join(sizes(r, "reference"), "reference")
    j = F.col("shared") / (F.col("n_query") + F.col("n_reference") - F.col("shared"))
    out = out.withColumn("jaccard", j)
    return out.select("query", "reference", "shared", "jaccard", (100 * (1 + F.log(2 * F.col("jaccard") / (1 + F.col("jaccard"))) / k)).alias("ani"))
