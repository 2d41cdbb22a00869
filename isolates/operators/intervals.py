"""Interval sets (set_id, chrom, start_pos, end_pos; 0-based, half-open): merge, membership, intersection, difference.

Range conditions would make Spark compare every pair of rows. Here both sides are put into bins of ``BIN``
positions, joined on equal bins, and a pair is kept in the bin where its overlap starts, so it appears once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a bin. An interval has one row for each bin that it touches.
BIN = 1_000


def merge_intervals(intervals: DataFrame, key: str = "set_id") -> DataFrame:
    """Overlapping and touching intervals of a set as one; empty and reversed ones are left out."""
    on = W.partitionBy(key, "chrom").orderBy("start_pos", "end_pos")
    kept = intervals.filter(F.col("start_pos") < F.col("end_pos")).select(key, "chrom", "start_pos", "end_pos")
    reach = F.max("end_pos").over(on.rowsBetween(W.unboundedPreceding, -1))
    begins = kept.withColumn("new", F.when(reach.isNull() | (F.col("start_pos") > reach), 1).otherwise(0))
    groups = begins.withColumn("group", F.sum("new").over(on.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return groups.groupBy(key, "chrom", "group").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("group")


def binned(intervals: DataFrame, width: int = BIN) -> DataFrame:
    """``intervals`` once for each bin that they touch, the bin in ``bin``."""
    first, last = F.floor(F.col("start_pos") / width), F.floor((F.col("end_pos") - 1) / width)
    return intervals.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))


def mean_width(intervals: DataFrame) -> int:
    """The mean length of ``intervals``: bins of this width hold few intervals, and all intervals touch twice their number of bins at most.

    Runs one aggregation; for tables of short pieces, of which a bin of ``BIN`` positions would hold too many to pair.
    """
    mean = intervals.agg(F.avg(F.col("end_pos") - F.col("start_pos"))).first()[0]
    return max(1, math.ceil(mean or 1))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals on equal ``keys`` (chrom among them), with the overlap as start_pos and end_pos.

    ``right``'s own start and end come as r_start and r_end; it must share no other names with ``left``.
    """
    other = binned(right, width).withColumnsRenamed({"start_pos": "r_start", "end_pos": "r_end"})
    mine = binned(left, width).withColumnsRenamed({"start_pos": "l_start", "end_pos": "l_end"})
    met = mine.join(other, [*keys, "bin"]).withColumn("start_pos", F.greatest("l_start", "r_start")).withColumn("end_pos", F.least("l_end", "r_end"))
    once = F.floor(F.col("start_pos") / width) == F.col("bin")
    return met.filter((F.col("start_pos") < F.col("end_pos")) & once).drop("bin")


def intersect(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The parts that both sets hold, for merged sets on equal ``keys``."""
    return overlap_join(left.select(*keys, "start_pos", "end_pos"), right.select(*keys, "start_pos", "end_pos"), keys).select(*keys, "start_pos", "end_pos")


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What ``left`` holds and ``right`` does not: a sweep over starts and ends, where left is open and right is not."""

    def events(df: DataFrame, a: int, b: int) -> DataFrame:
        kept = df.filter(F.col("start_pos") < F.col("end_pos"))
        return kept.select(*keys, F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(a).alias("da"), F.lit(b).alias("db")), F.struct(F.col("end_pos").alias("pos"), F.lit(-a).alias("da"), F.lit(-b).alias("db")))).alias("e")).select(*keys, "e.*")

    all_ = events(left, 1, 0).union(events(right, 0, 1)).groupBy(*keys, "pos").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    on = W.partitionBy(*keys).orderBy("pos")
    upto = on.rowsBetween(W.unboundedPreceding, W.currentRow)
    open_ = all_.withColumns({"a": F.sum("da").over(upto), "b": F.sum("db").over(upto), "next": F.lead("pos").over(on)})
    parts = open_.filter((F.col("a") > 0) & (F.col("b") == 0) & F.col("next").isNotNull())
    parts = parts.select(*keys, F.col("pos").alias("start_pos"), F.col("next").alias("end_pos"))
    named = parts.withColumn("__set", F.concat_ws("|", *keys))
    on = W.partitionBy(*keys).orderBy("start_pos")
    before = F.lag("end_pos").over(on)
    named = named.withColumn("g", F.sum(F.when(before == F.col("start_pos"), 0).otherwise(1)).over(on))
    return named.groupBy(*keys, "g").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("g")


def inside(positions: DataFrame, regions: DataFrame, keys: list[str], how: str = "left_semi", width: int = BIN) -> DataFrame:
    """Rows of ``positions`` (1-based ``pos``) inside (``left_semi``) or outside (``left_anti``) the regions of equal keys."""
    spots = binned(regions.select(*keys, "start_pos", "end_pos"), width).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), "start_pos", "end_pos")
    at = F.col("pos") - 1
    same = F.floor(at / width) == F.col("__bin")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return positions.join(spots, same & (at >= F.col("start_pos")) & (at < F.col("end_pos")), how)


def lengths(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Bases held by each merged set."""
    return intervals.groupBy(*keys).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


def masked_fraction(mask: DataFrame, contigs: DataFrame) -> DataFrame:
    """(bases, masked, fraction) of a merged mask (chrom, start_pos, end_pos) over contigs (chrom, length)."""
    held = mask.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("m"))
    joined = contigs.join(held, "chrom", "left")
    return joined.agg(F.sum("length").alias("bases"), F.sum(F.coalesce("m", F.lit(0))).alias("masked")).withColumn("fraction", F.try_divide(F.col("masked").cast("double"), F.nullif(F.col("bases").cast("double"), F.lit(0.0))))


def whole_contigs(contigs: DataFrame, set_id: str = "all") -> DataFrame:
    """One interval for each contig (chrom, length)."""
    return contigs.select(F.lit(set_id).alias("set_id"), "chrom", F.lit(0).cast("int").alias("start_pos"), F.col("length").cast("int").alias("end_pos"))


def from_one_based(rows: DataFrame) -> DataFrame:
    """1-based inclusive starts and ends as 0-based half-open ones."""
    return rows.withColumn("start_pos", F.col("start_pos") - 1)


def low_complexity(sequences: DataFrame, length: int = 48, step: int = 24, share: float = 0.92) -> DataFrame:
    """Merged windows (chrom, start_pos, end_pos) in which two bases make up ``share`` or more. ``sequences``: chrom, seq."""
    # the sequence is cut once into pieces that windows are made of, so that no window is looked up from its start
    piece = math.gcd(length, step)
    cut = sequences.filter(F.length("seq") >= length).select("chrom", F.length("seq").alias("n"), F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s)(.{{{piece}}})"), 1).alias("pieces"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - length, F.lit(step)), lambda a: F.struct(a.alias("start_pos"), F.array_join(F.slice("pieces", (a / piece).cast("int") + 1, length // piece), "").alias("window")))
    at = cut.select("chrom", F.inline(windows))
    window = F.col("window")
    counts = F.reverse(F.array_sort(F.array(*[F.length(window) - F.length(F.replace(window, F.lit(b), F.lit(""))) for b in "ACGT"])))
    found = at.filter(F.element_at(counts, 1) + F.element_at(counts, 2) >= share * length)
    found = found.select(F.lit("low").alias("set_id"), "chrom", "start_pos", (F.col("start_pos") + length).alias("end_pos"))
    return merge_intervals(found).drop("set_id")


def homopolymers(sequences: DataFrame, length: int = 12) -> DataFrame:
    """(chrom, start_pos, end_pos) of runs of one base, ``length`` or longer."""
    runs = F.regexp_extract_all(F.upper("seq"), F.lit("(A+|C+|G+|T+|[^ACGT]+)"), 1)
    laid = sequences.select("chrom", F.posexplode(runs).alias("i", "run"))
    before = W.partitionBy("chrom").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("start_pos", F.coalesce(F.sum(F.length("run")).over(before), F.lit(0)).cast("int"))
    return laid.filter(F.col("run").rlike("^[ACGT]") & (F.length("run") >= length)).select("chrom", "start_pos", (F.col("start_pos") + F.length("run")).alias("end_pos"))


def build_mask(parts: list[DataFrame], contigs: DataFrame, most: float) -> DataFrame:
    """The union of interval tables (chrom, start_pos, end_pos), merged; an error if it covers more than ``most``."""
    out = parts[0].select("chrom", "start_pos", "end_pos")
    for part in parts[1:]:
        out = out.union(part.select("chrom", "start_pos", "end_pos"))
    mask = merge_intervals(out.withColumn("set_id", F.lit("mask"))).drop("set_id")
    share = masked_fraction(mask, contigs).first()["fraction"]
    if share is not None and share > most:
        raise ValueError(f"the mask covers {share:.1%} of the reference, over {most:.0%}")
    return mask
