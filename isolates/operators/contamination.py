"""Mixture and contamination: heterozygosity, lineage mixture statistics, purity and sample validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALIDITY_ORDER, VALUE
from isolates.operators.lineage import by_position
from isolates.operators.sites import minor_fractions

USES = ("resistance", "transmission")
MIXTURE_ORDER = ("single-strain", "possible-mixture", "mixed")


def passes_mixture_filters() -> Column:
    """Depth and quality of a site for mixture statistics; a missing quality fails."""
    return F.coalesce((F.col("depth") >= VALUE["het_min_depth"]) & (F.col("qual") >= VALUE["het_min_qual"]), F.lit(False))


def heterozygosity(sites: DataFrame) -> DataFrame:
    """(sample_id, het_fraction, het_sites, sites_examined) over SNP sites with counts and ``qual``; NULL if none passes."""
    marked = minor_fractions(sites).withColumn("ok", passes_mixture_filters())
    het = F.col("ok") & (F.col("minor_fraction") >= VALUE["min_minor_fraction"])
    out = marked.groupBy("sample_id").agg(F.count_if(het).alias("het_sites"), F.count_if("ok").alias("sites_examined"))
    return out.select("sample_id", E.ratio("het_sites", "sites_examined").alias("het_fraction"), "het_sites", "sites_examined")


def unambiguous_fraction(sites: DataFrame, majority: float = VALUE["unambiguous"]) -> DataFrame:
    """(sample_id, unambiguous_fraction): covered sites whose commonest base reaches ``majority``."""
    seen = minor_fractions(sites).filter("depth > 0")
    return seen.groupBy("sample_id").agg(E.ratio(F.count_if(F.col("major_fraction") >= majority), F.count("*")).alias("unambiguous_fraction"))


def top_mean(values: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """(sample_id, name): the mean of the ``n`` largest values; no row where there are fewer."""
    order = W.partitionBy("sample_id").orderBy(F.desc(column))
    best = values.filter(F.col(column).isNotNull()).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n)
    return best.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg(column).alias(name)).filter(F.col("n") == n).drop("n")


def lineage_mixture(sites: DataFrame, barcode: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F2 and F47 by sample, and the minority evidence of each lineage.

    ``sites``: counts with ``qual``; ``barcode``: chrom, pos, taxon, allele. The first table has sample_id, f2, f47,
    sites_examined; the second sample_id, taxon, callable_fraction, mean_fraction and minority_evidence: a callable
    share of 0.8 or more and a mean derived fraction from 0.05 to under 0.90.
    """
    panel = minor_fractions(sites).join(by_position(barcode), ["chrom", "pos"]).withColumn("ok", passes_mixture_filters())
    usable = panel.filter("ok")
    f = usable.groupBy("sample_id").agg(F.count("*").alias("sites_examined"))
    for n in (2, 47):
        f = f.join(top_mean(usable, "minor_fraction", n, f"f{n}"), "sample_id", "left")
    derived = E.ratio(E.count_of(F.col("allele")), F.col("depth"))
    wanted = sites.select("sample_id").distinct().join(F.broadcast(barcode.groupBy("taxon").agg(F.count("*").alias("sites_total"))), how="cross")
    by_taxon = panel.groupBy("sample_id", "taxon").agg(F.count_if("ok").alias("sites_callable"), F.avg(F.when(F.col("ok"), derived)).alias("mean_fraction"))
    out = wanted.join(by_taxon, ["sample_id", "taxon"], "left").withColumn("sites_callable", F.coalesce("sites_callable", F.lit(0)))
    out = out.withColumn("callable_fraction", E.ratio("sites_callable", "sites_total"))
    minority = (F.col("callable_fraction") >= VALUE["barcode_callable"]) & (F.col("mean_fraction") >= VALUE["min_minor_fraction"]) & (F.col("mean_fraction") < VALUE["major_variant_fraction"])
    return f, out.withColumn("minority_evidence", F.coalesce(minority, F.lit(False)))


def mixture_class(het: Column, f2: Column, f47: Column, platform: str) -> Column:
    """The worst class that any of the three statistics gives; not-assessed without any, on assemblies, and for a single
    strain on ONT, where absence of a minor variant says nothing."""
    if platform == "fasta":
        return F.lit("not-assessed")
    tier = F.when(het >= VALUE["het_fraction_mixed"], 2).when(het >= VALUE["het_fraction_warn"], 1).when(het.isNotNull(), 0)
    by_f = lambda x, t: F.when(x >= VALUE[t], 1).when(x.isNotNull(), 0)
    worst = F.greatest(tier, by_f(f2, "f2_mixture"), by_f(f47, "f47_mixture"))
    named = F.element_at(F.array(*[F.lit(c) for c in MIXTURE_ORDER]), worst + 1)
    single = "not-assessed" if platform == "ont" else MIXTURE_ORDER[0]
    return F.when(worst.isNull(), "not-assessed").when(worst == 0, single).otherwise(named)


def purity(qc: DataFrame, reference_gc: float | None = None) -> DataFrame:
    """``qc`` (mapped_fraction, breadth, evenness, gc) with ``gc_within``: NULL where either is unknown."""
    gap = F.abs(F.col("gc") - F.lit(reference_gc).cast("double"))
    return qc.withColumn("gc_within", gap <= VALUE["gc_tolerance"])


def validity_votes(panel: DataFrame) -> DataFrame:
    """(sample_id, dimension, use, vote): what each measured dimension says about each use.

    ``panel``: sample_id, mixture, mapped_fraction, breadth, evenness, gc_within, non_target_fraction,
    unambiguous_fraction. A dimension within its threshold does not vote, except mixture, which always does.
    """

    def vote(condition: Column, *says: str | None) -> Column:
        return F.when(condition, F.array(*[F.lit(s).cast("string") for s in says]))

    c = F.col
    mixture = (
        F.when(c("mixture") == "mixed", F.array(F.lit("invalid"), F.lit("invalid")))
        .when(c("mixture") == "possible-mixture", F.array(F.lit("suspect"), F.lit("invalid")))
        .when(c("mixture") == "single-strain", F.array(F.lit("valid"), F.lit("valid")))
        .otherwise(F.array(F.lit("not-assessed"), F.lit("not-assessed")))
    )
    dimensions = {
        "mixture": mixture,
        "mapped_read_fraction": F.coalesce(vote(c("mapped_fraction").isNull(), "not-assessed", "not-assessed"), vote(c("mapped_fraction") < VALUE["min_mapped_fraction"], "suspect", "invalid")),
        "coverage_breadth": F.coalesce(vote(c("breadth").isNull(), "valid", "not-assessed"), vote(c("breadth") < VALUE["min_breadth"], "suspect", "invalid")),
        "coverage_evenness": vote(c("evenness") < VALUE["min_evenness"], "suspect", "suspect"),
        "gc_content": vote(~c("gc_within"), "suspect", "suspect"),
        "non_target_read_fraction": vote(c("non_target_fraction") > VALUE["max_non_target"], "suspect", "invalid"),
        "unambiguous_base_fraction": vote(c("unambiguous_fraction") < VALUE["unambiguous"], "suspect", "suspect"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("votes")) for n, v in dimensions.items()]))
    laid = panel.select("sample_id", rows.alias("d")).filter("d.votes is not null")
    return laid.select("sample_id", "d.dimension", F.posexplode("d.votes").alias("i", "vote")).select(
        "sample_id", "dimension", F.element_at(F.array(*[F.lit(u) for u in USES]), F.col("i") + 1).alias("use"), "vote"
    )


def sample_validity(panel: DataFrame) -> DataFrame:
    """(sample_id, use, verdict, reasons): the worst vote for each use and the dimensions that cast it.

    Not-assessed outranks valid, so a sample that nobody could assess never reads as one that passed.
    """
    votes = validity_votes(panel).withColumn("rank", E.ranked(VALIDITY_ORDER, F.col("vote")))
    worst = votes.withColumn("worst", F.max("rank").over(W.partitionBy("sample_id", "use")))
    return worst.groupBy("sample_id", "use").agg(
        F.max_by("vote", "rank").alias("verdict"), F.sort_array(F.collect_set(F.when(F.col("rank") == F.col("worst"), F.col("dimension")))).alias("reasons")
    )


def non_target(assignments: DataFrame) -> DataFrame:
    """(sample_id, fraction, resolution) of reads assigned to other references.

    ``assignments``: sample_id, reads, fraction, is_target, resolution (species, complex or genus). Shares come from read
    counts if there are any, else from stated fractions; the coarsest resolution of any assignment is that of all.
    """
    out = assignments.groupBy("sample_id").agg(
        F.sum(F.coalesce("reads", F.lit(0))).alias("all_reads"),
        F.sum(F.when(~F.col("is_target"), F.coalesce("reads", F.lit(0)))).alias("other"),
        F.sum(F.when(~F.col("is_target"), F.col("fraction"))).alias("stated"),
        F.min_by("resolution", E.ranked(("genus", "complex", "species"), F.col("resolution"))).alias("resolution"),
    )
    share = F.when(F.col("all_reads") > 0, E.ratio(F.coalesce("other", F.lit(0)), F.col("all_reads"))).otherwise(F.col("stated"))
    return out.select("sample_id", share.alias("fraction"), F.when(share.isNotNull(), F.col("resolution")).alias("resolution"))


def foreign_taxa(report: DataFrame, target: str) -> DataFrame:
    """Species-rank taxa of a classifier report (sample_id, percentage, rank, name) that are not ``target`` and above
    the report floor, largest first within a sample."""
    share = F.col("percentage") / 100
    kept = report.filter((F.trim("rank") == "S") & (share > VALUE["taxon_report_floor"]) & ~F.lower(F.trim("name")).startswith(target.lower()))
    order = W.partitionBy("sample_id").orderBy(F.desc("percentage"), "name")
    return kept.select("sample_id", F.trim("name").alias("name"), share.alias("share"), F.row_number().over(order).alias("rank"))


def screen_informative(index: str | None, confidence: float | None, mycobacterial_indexes: tuple[str, ...] = ()) -> bool:
    """Whether a classifier screen says anything: its index must be declared and its confidence above zero, else an error;
    an index that is not among those known to hold the target's relatives gives no evidence either way."""
    if not index:
        raise ValueError("the classifier's index must be declared")
    if confidence is None or not 0 < confidence <= 1:
        raise ValueError(f"the classifier's confidence must lie above 0 and up to 1; got {confidence!r}")
    return index in mycobacterial_indexes


def screen(report: DataFrame, target: str, informative: bool) -> DataFrame:
    """(sample_id, largest_foreign, status): the largest foreign share against its limit; NULL and a warning if the screen says nothing."""
    samples = report.select("sample_id").distinct()
    most = foreign_taxa(report, target).groupBy("sample_id").agg(F.max("share").alias("largest_foreign"))
    out = samples.join(most, "sample_id", "left").withColumn("largest_foreign", F.when(F.lit(informative), F.coalesce("largest_foreign", F.lit(0.0))))
    status = F.when(F.col("largest_foreign").isNull(), "warn").when(F.col("largest_foreign") > VALUE["max_non_target"], "fail").otherwise("pass")
    return out.withColumn("status", status)
