"""Depth histograms and what they say: mean, exact median, breadth, evenness, and the callable regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions.expressions import ratio
from isolates.functions.thresholds import VALUE


def depth_histogram(depths: DataFrame) -> DataFrame:
    """(sample_id, chrom, depth, positions) from per-position depths (sample_id, chrom, pos, depth)."""
    return depths.groupBy("sample_id", "chrom", "depth").agg(F.count("*").alias("positions"))


def merge_contigs(histogram: DataFrame) -> DataFrame:
    """The histogram of each sample's whole reference."""
    return histogram.groupBy("sample_id", "depth").agg(F.sum("positions").alias("positions"))


def coverage(histogram: DataFrame, lengths: DataFrame, breadth_at: int = int(VALUE["callable_depth"])) -> DataFrame:
    """One row a sample: positions, mean, median, breadth and evenness, over the whole reference.

    ``histogram``: sample_id, depth, positions. ``lengths``: sample_id, length. Positions of the reference that the
    histogram lacks count as depth zero. The median is exact: the mean of the two middle positions if they are even.
    A sample without positions has NULLs. Breadth is the share at ``breadth_at`` or more, evenness the share within
    0.5 to 2 times the mean. Depth values are few, so running sums over them are small.
    """
    seen = histogram.groupBy("sample_id").agg(F.sum("positions").alias("seen"), F.sum(F.col("depth") * F.col("positions")).alias("bases"))
    total = lengths.join(seen, "sample_id", "left").select(
        "sample_id", F.greatest("length", F.coalesce("seen", F.lit(0))).alias("total"), F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("bases", F.lit(0)).alias("bases")
    )
    missing = total.filter(F.col("total") > F.col("seen")).select("sample_id", F.lit(0).cast("long").alias("depth"), (F.col("total") - F.col("seen")).alias("positions"))
    full = histogram.select("sample_id", F.col("depth").cast("long").alias("depth"), "positions").union(missing)
    full = full.groupBy("sample_id", "depth").agg(F.sum("positions").alias("positions"))
    so_far = W.partitionBy("sample_id").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = full.withColumn("upto", F.sum("positions").over(so_far)).join(total, "sample_id", "right")
    mean = ratio("bases", "total")
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)  # ranks of the middle positions, from 0
    holds = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("depth")))
    within = (F.col("depth") >= VALUE["evenness_low"] * mean) & (F.col("depth") <= VALUE["evenness_high"] * mean)
    out = full.groupBy("sample_id").agg(
        F.max("total").alias("total"),
        F.max("bases").alias("bases"),
        holds(low).alias("low"),
        holds(high).alias("high"),
        F.coalesce(F.sum(F.when(F.col("depth") >= breadth_at, F.col("positions"))), F.lit(0)).alias("deep"),
        F.coalesce(F.sum(F.when(within & (mean > 0), F.col("positions"))), F.lit(0)).alias("even"),
    )
    return out.select(
        "sample_id",
        F.col("total").alias("positions"),
        ratio("bases", "total").alias("mean_depth"),
        ((F.col("low") + F.col("high")) / 2).alias("median_depth"),
        ratio("deep", "total").alias("breadth"),
        F.when(F.col("bases") > 0, ratio("even", "total")).alias("evenness"),
    )


def coverage_qc(coverage_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Coverage with the library's reads: mapped share, and duplicate share where duplicates were marked (else NULL).

    ``stats``: sample_id, reads, mapped, duplicates, duplicates_marked, gc.
    """
    return coverage_rows.join(stats, "sample_id", "left").select(
        *coverage_rows.columns,
        ratio("mapped", "reads").alias("mapped_fraction"),
        F.when(F.col("duplicates_marked"), ratio("duplicates", "reads")).alias("duplicate_fraction"),
        "gc",
    )


def callable_regions(depths: DataFrame, min_depth: int = int(VALUE["callable_depth"])) -> DataFrame:
    """(sample_id, chrom, start_pos, end_pos), 0-based half-open runs of positions with at least ``min_depth`` reads."""
    deep = depths.filter(F.col("depth") >= min_depth).select("sample_id", "chrom", "pos").distinct()
    island = F.col("pos") - F.row_number().over(W.partitionBy("sample_id", "chrom").orderBy("pos"))
    return (
        deep.withColumn("island", island)
        .groupBy("sample_id", "chrom", "island")
        .agg((F.min("pos") - 1).alias("start_pos"), F.max("pos").alias("end_pos"))
        .drop("island")
    )


def read_profile(reads: DataFrame, long_read: int = 1000) -> DataFrame:
    """One row a sample: number, least, most, mean, median length, N50, share of long reads, variation, mean quality.

    ``reads``: sample_id, length, quality (mean phred, may be NULL).
    """
    by_length = reads.groupBy("sample_id", "length").agg(F.count("*").alias("n"))
    down = W.partitionBy("sample_id").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)
    all_ = W.partitionBy("sample_id")
    held = by_length.withColumn("upto", F.sum(F.col("length") * F.col("n")).over(down)).withColumn("bases", F.sum(F.col("length") * F.col("n")).over(all_))
    n50 = held.filter(F.col("upto") * 2 >= F.col("bases")).groupBy("sample_id").agg(F.max("length").alias("n50"))
    out = reads.groupBy("sample_id").agg(
        F.count("*").alias("reads"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"),
        F.percentile("length", F.lit(0.5)).alias("median_length"),
        ratio(F.count_if(F.col("length") >= long_read), F.count("*")).alias("long_share"),
        ratio(F.stddev_pop("length"), F.avg("length")).alias("length_variation"),
        F.avg("quality").alias("mean_quality"),
    )
    return out.join(n50, "sample_id", "left")


def infer_platform(profiles: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``profiles`` with platform and confidence: ont for long reads (a tenth over 1000, or a median that long), illumina
    for short ones (none over 400), else undecided at low confidence. A file-name hint (sample_id, hint) that says
    otherwise lowers the confidence by a step."""
    long = (F.col("long_share") >= 0.10) | (F.col("median_length") >= 1000)
    short = F.col("max_length") <= 400
    out = profiles.withColumn("platform", F.when(long, "ont").when(short, "illumina").otherwise(F.when(F.col("median_length") > 400, "ont").otherwise("illumina")))
    out = out.withColumn("confidence", F.when(long | short, "high").otherwise("low"))
    if hints is None:
        return out
    out = out.join(hints, "sample_id", "left")
    conflict = F.col("hint").isNotNull() & (F.col("hint") != F.col("platform"))
    lower = F.when(F.col("confidence") == "high", "moderate").otherwise("low")
    return out.withColumn("confidence", F.when(conflict, lower).otherwise(F.col("confidence"))).drop("hint")


def quality_encoding(qualities: DataFrame) -> DataFrame:
    """(sample_id, encoding) from quality strings (sample_id, qual): phred33, phred64 or ambiguous, by the lowest and highest mark."""
    marks = qualities.select("sample_id", F.array_min(F.split("qual", "")).alias("low"), F.array_max(F.split("qual", "")).alias("high")).filter(F.col("low") != "")
    held = marks.groupBy("sample_id").agg(F.ascii(F.min("low")).alias("low"), F.ascii(F.max("high")).alias("high"))
    kind = F.when(F.col("low") < 59, "phred33").when(F.col("high") > 80, "phred64").otherwise("ambiguous")
    return held.select("sample_id", kind.alias("encoding"), "low", "high")


def assembly_stats(sequences: DataFrame) -> DataFrame:
    """One row a sample: contigs, bases, N50, GC share of the four bases, and ambiguous bases. ``sequences``: sample_id, seq."""
    base = sequences.select("sample_id", F.length("seq").alias("length"), F.upper("seq").alias("seq"))
    count = lambda pattern: F.length("seq") - F.length(F.regexp_replace("seq", pattern, ""))
    base = base.select("sample_id", "length", count("[GC]").alias("gc"), count("[ACGT]").alias("known"))
    down = W.partitionBy("sample_id").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = base.withColumns({"upto": F.sum("length").over(down), "bases": F.sum("length").over(W.partitionBy("sample_id"))})
    return held.groupBy("sample_id").agg(
        F.count("*").alias("contigs"), F.sum("length").alias("bases"), F.max(F.when(F.col("upto") * 2 >= F.col("bases"), F.col("length"))).alias("n50"),
        ratio(F.sum("gc"), F.sum("known")).alias("gc"), (F.sum("length") - F.sum("known")).alias("ambiguous"),
    )
