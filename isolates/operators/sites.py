"""Operators on tables of per-position allele counts, many samples at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE, min_reads


def with_alleles(sites: DataFrame, convention: str = "acgt") -> DataFrame:
    """``sites`` with depth, allele, fraction and tie flag; fraction and allele are NULL without reads."""
    depth = E.depth(convention)
    out = sites.withColumn("depth", depth).withColumn("allele", E.major_allele(convention))
    out = out.withColumn("tie", (E.highest_count() > 0) & E.is_tied())
    return out.withColumn("fraction", E.ratio(E.count_of(F.col("allele")), F.col("depth")))


def genotype_sites(sites: DataFrame, platform: str, min_fraction: float | None = None, convention: str = "acgt", reads: int | None = None) -> DataFrame:
    """``sites`` with allele, fraction, depth, ``supported`` and, where not, the ``reason``.

    ONT takes the highest allele whatever its fraction; elsewhere it must reach ``min_fraction`` if one is given.
    A site that is not covered has NULL allele and fraction, never a reference call.
    """
    floor = min_reads(platform) if reads is None else reads
    covered = F.coalesce(F.col("covered"), F.lit(True)) if "covered" in sites.columns else F.lit(True)
    out = with_alleles(sites, convention)
    no_reads = ~covered | (F.coalesce("depth", F.lit(0)) == 0)
    reason = (
        F.when(no_reads, "no reads")
        .when(F.col("allele").isNull(), "tie")
        .when(E.count_of(F.col("allele")) < floor, "few reads")
    )
    if platform != "ont" and min_fraction is not None:
        reason = reason.when(F.col("fraction") < min_fraction, "low fraction")
    out = out.withColumn("reason", reason.otherwise(""))
    shown = lambda c: F.when(no_reads, None).otherwise(F.col(c))
    return out.withColumns(
        {"depth": F.when(no_reads, 0).otherwise(F.col("depth")), "allele": shown("allele"), "fraction": shown("fraction"), "supported": F.col("reason") == ""}
    )


def alleles_present(sites: DataFrame, min_fraction: float = VALUE["min_minor_fraction"], reads: int = 1) -> DataFrame:
    """One row for each base of a site above the floors, with its rank, commonest first and then by letter."""
    depth = E.acgt_depth()
    found = sites.select("*", F.posexplode(E.base_counts()).alias("i", "x")).select("sample_id", "chrom", "pos", "x.base", "x.n", E.ratio(F.col("x.n"), depth).alias("fraction"), (F.col("i") + 1).alias("rank"))
    return found.filter((F.col("n") >= reads) & (F.col("fraction") >= min_fraction))


def minor_fractions(sites: DataFrame) -> DataFrame:
    """``sites`` with depth, major and minor base and their fractions, NULL without reads."""
    out = sites.withColumn("depth", E.acgt_depth()).withColumn("__r", E.base_counts())
    pick = lambda i, f: F.element_at("__r", i)[f]
    some = lambda i, f: F.when(pick(i, "n") > 0, pick(i, f))
    return out.withColumns(
        {"major_base": some(1, "base"), "minor_base": some(2, "base"), "major_fraction": E.ratio(pick(1, "n"), F.col("depth")), "minor_fraction": E.ratio(pick(2, "n"), F.col("depth"))}
    ).drop("__r")


def at_positions(sites: DataFrame, samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted (chrom, pos) of every sample; where a sample has no site, ``covered`` is false and counts are NULL.

    ``samples`` has one row a sample and ``wanted`` is a scheme's positions; their product is the output itself.
    """
    grid = samples.select("sample_id").distinct().join(F.broadcast(wanted.select("chrom", "pos").distinct()), how="cross")
    marked = sites.withColumn("covered", F.coalesce(F.col("covered"), F.lit(True)) if "covered" in sites.columns else F.lit(True))
    found = grid.join(marked, ["sample_id", "chrom", "pos"], "left")
    return found.withColumn("covered", F.coalesce("covered", F.lit(False)))


def required_positions(*schemes: DataFrame) -> DataFrame:
    """The distinct positions that any of the schemes needs."""
    out = schemes[0].select("chrom", "pos")
    for other in schemes[1:]:
        out = out.union(other.select("chrom", "pos"))
    return out.distinct()


def translate_contigs(sites: DataFrame, aliases: DataFrame, scheme_contigs: DataFrame) -> DataFrame:
    """``sites`` with contig names as the scheme has them.

    A name of the scheme stays; an alias (columns alias, chrom) is replaced; otherwise a sample with one contig is
    taken to mean the scheme's only one; else the name stays as it is and simply will not join.
    """
    known = scheme_contigs.select(F.col("chrom").alias("__known")).distinct()
    only = known.agg(F.when(F.count("*") == 1, F.max("__known")).alias("__only"))
    used = sites.select("sample_id", "chrom").distinct().groupBy("sample_id").agg((F.count("*") == 1).alias("__single"))
    out = sites.join(F.broadcast(known), sites["chrom"] == F.col("__known"), "left")
    renamed = aliases.select(F.col("alias").alias("__alias"), F.col("chrom").alias("__target")).dropDuplicates(["__alias"])
    out = out.join(F.broadcast(renamed), out["chrom"] == F.col("__alias"), "left").join(used, "sample_id").join(F.broadcast(only), how="cross")
    name = F.coalesce("__known", "__target", F.when(F.col("__single"), F.col("__only")), F.col("chrom"))
    return out.withColumn("chrom", name).drop("__known", "__alias", "__target", "__single", "__only")


def allele_fraction_at(ref: Column, alt: Column) -> Column:
    """Share of a site's reads with a given change: a base, an insertion or a deletion (map columns ins and del); else NULL."""
    ref, alt = F.upper(ref), F.upper(alt)
    depth = E.acgt_depth()
    n = (
        F.when((F.length(ref) == 1) & (F.length(alt) == 1), E.count_of(alt))
        .when((F.length(alt) > F.length(ref)) & F.startswith(alt, ref), F.coalesce(F.col("ins")[F.substr(alt, F.length(ref) + 1)], F.lit(0)))
        .when((F.length(ref) > F.length(alt)) & F.startswith(ref, alt), F.coalesce(F.col("del")[F.substr(ref, F.length(alt) + 1)], F.lit(0)))
    )
    return F.when(F.coalesce(F.col("covered"), F.lit(True)), E.ratio(n, depth))


def backfill_fractions(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """``variants`` whose missing allele fraction comes from the site's counts; NULL stays where there is no covered site."""
    empty = F.create_map().cast("map<string,int>")
    for name in ("ins", "del"):
        if name not in sites.columns:
            sites = sites.withColumn(name, empty)
    if "covered" not in sites.columns:
        sites = sites.withColumn("covered", F.lit(True))
    counts = sites.select("sample_id", "chrom", "pos", "n_a", "n_c", "n_g", "n_t", "ins", "del", "covered")
    joined = variants.join(counts, ["sample_id", "chrom", "pos"], "left")
    filled = F.coalesce("allele_fraction", F.when(F.col("covered"), allele_fraction_at(F.col("ref"), F.col("alt"))))
    return joined.withColumn("allele_fraction", filled).select(variants.columns)


def snp_observations(variants: DataFrame) -> DataFrame:
    """Counts of the two alleles of single-base variants, for mixture statistics; both read counts must be known."""
    kept = variants.filter((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("ref_reads").isNotNull() & F.col("alt_reads").isNotNull())
    n = lambda b: (F.when(F.upper("ref") == b, F.col("ref_reads")).otherwise(0) + F.when(F.upper("alt") == b, F.col("alt_reads")).otherwise(0)).cast("long")
    return kept.select("sample_id", "chrom", "pos", *[n(b).alias(c) for b, c in E.COUNT.items() if b in E.BASES], "qual")


def require_shared_contigs(left: DataFrame, right: DataFrame, what: str) -> None:
    """An error if both tables have contigs and none is in both: they stand on different references."""
    names = left.select("chrom").distinct()
    if not names.isEmpty() and not right.isEmpty() and names.join(right.select("chrom").distinct(), "chrom", "left_semi").isEmpty():
        raise ValueError(f"{what}: no contig name is in both tables")


def require_one_reference(samples: DataFrame) -> None:
    """An error if samples (column reference) of one cohort were called on several references."""
    named = samples.filter(F.coalesce("reference", F.lit("")) != "").agg(F.count_distinct("reference").alias("n"), F.min("reference").alias("a"), F.max("reference").alias("b")).first()
    if named["n"] > 1:
        raise ValueError(f"samples of one cohort were called against different references, {named['a']} and {named['b']} among them")
