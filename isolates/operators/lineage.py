"""Lineage calls from a barcode of taxon-defining positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE, min_reads

#: Family names of animal lineages, and the sign of BCG. Fixed values.
ANIMAL_ROOTS = ("La1", "La2", "La3")
BCG_SUFFIX = ".BCG"
#: Positions up to which a barcode is sent to every task.
SCHEME_ROWS = 100_000


def by_position(barcode: DataFrame) -> DataFrame:
    """``barcode`` for a join on its positions: broadcast as the scheme that it mostly is, or sorted and merged where it has
    more rows. Spark's own guess goes by the size of files, which says little of rows in the driver's memory."""
    return F.broadcast(barcode) if barcode.limit(SCHEME_ROWS + 1).count() <= SCHEME_ROWS else barcode.hint("merge")


def genotype_barcode(sites: DataFrame, barcode: DataFrame, platform: str, minor_fraction: float = VALUE["min_minor_fraction"], reads: int | None = None) -> DataFrame:
    """Every barcode position of every sample: depth, allele, callable, supports, minor_support.

    ``barcode``: chrom, pos, taxon, alleles (array). Positions without a site are not callable. The names of the samples
    are broadcast, the barcode only if Spark finds that it fits; the grid is the output itself.
    """
    samples = sites.select("sample_id").distinct()
    grid = F.broadcast(samples).join(barcode, how="cross")
    counts = sites.select("sample_id", "chrom", "pos", "n_a", "n_c", "n_g", "n_t")
    counts = counts.join(by_position(barcode.select("chrom", "pos").distinct()), ["chrom", "pos"], "left_semi")
    return _genotyped(grid.join(counts, ["sample_id", "chrom", "pos"], "left"), platform, minor_fraction, reads)


def _genotyped(out: DataFrame, platform: str, minor_fraction: float, reads: int | None) -> DataFrame:
    """Rows of a barcode position with a sample's counts, NULL without a site, and what they say."""
    floor = min_reads(platform) if reads is None else reads
    depth = F.coalesce(E.acgt_depth(), F.lit(0))
    out = out.withColumn("depth", depth).withColumn("observed", F.when(depth > 0, E.major_allele()))
    target = sum((F.when(F.array_contains("alleles", b), F.coalesce(E.COUNT[b], F.lit(0))).otherwise(0) for b in E.BASES), F.lit(0))
    out = out.withColumn("target_reads", target).withColumn("target_fraction", E.ratio(F.col("target_reads"), F.col("depth")))
    out = out.withColumn("callable", (F.col("depth") >= floor) & F.col("observed").isNotNull())
    supports = F.col("callable") & F.array_contains("alleles", F.col("observed")) & (F.col("target_reads") >= floor)
    out = out.withColumn("supports", F.coalesce(supports, F.lit(False)))
    minor = F.col("callable") & ~F.col("supports") & (F.col("target_fraction") >= minor_fraction)
    return out.withColumn("minor_support", F.coalesce(minor, F.lit(False))).drop("n_a", "n_c", "n_g", "n_t")


def taxon_support(genotypes: DataFrame) -> DataFrame:
    """Sites, callable, supporting and minor by sample and taxon, their shares, and whether the taxon is supported."""
    known = [c for c in ("family", "spoligotype") if c in genotypes.columns]
    out = genotypes.groupBy("sample_id", "taxon").agg(
        F.count("*").alias("total"),
        F.count_if("callable").alias("callable_sites"),
        F.count_if("supports").alias("supporting"),
        F.count_if("minor_support").alias("minor"),
        *[F.max(c).alias(c) for c in known],
    )
    return _with_shares(out)


def barcode_support(sites: DataFrame, barcode: DataFrame, platform: str, minor_fraction: float = VALUE["min_minor_fraction"], reads: int | None = None) -> DataFrame:
    """What :func:`taxon_support` gives for :func:`genotype_barcode`, without the grid of all samples and positions.

    Only positions that have a site meet the barcode, by equal keys; the others count in a taxon's total, which is the
    barcode's own. A position is one row of a sample in ``sites``.
    """
    known = [c for c in ("family", "spoligotype") if c in barcode.columns]
    counts = sites.select("sample_id", "chrom", "pos", "n_a", "n_c", "n_g", "n_t")
    seen = _genotyped(counts.join(by_position(barcode), ["chrom", "pos"]), platform, minor_fraction, reads)
    numbers = {"callable_sites": "callable", "supporting": "supports", "minor": "minor_support"}
    seen = seen.groupBy(F.col("sample_id").alias("__sample"), F.col("taxon").alias("__taxon")).agg(*[F.count_if(c).alias(f"__{n}") for n, c in numbers.items()])
    totals = barcode.groupBy("taxon").agg(F.count("*").alias("total"), *[F.max(c).alias(c) for c in known])
    grid = sites.select("sample_id").distinct().join(F.broadcast(totals), how="cross")
    out = grid.join(seen, (F.col("sample_id") == F.col("__sample")) & F.col("taxon").eqNullSafe(F.col("__taxon")), "left")
    return _with_shares(out.select("sample_id", "taxon", "total", *[F.coalesce(f"__{n}", F.lit(0)).alias(n) for n in numbers], *known))


def _with_shares(out: DataFrame) -> DataFrame:
    """Counts by sample and taxon with their shares, and whether the taxon is supported."""
    out = out.withColumns(
        {
            "callable_fraction": E.ratio("callable_sites", "total"),
            "support_fraction": E.ratio("supporting", "callable_sites"),
            "minor_fraction": E.ratio("minor", "callable_sites"),
        }
    )
    enough = F.col("callable_fraction") >= VALUE["barcode_callable"]
    return out.withColumns(
        {
            "supported": F.coalesce(enough & (F.col("support_fraction") >= VALUE["barcode_support"]), F.lit(False)),
            "minor_supported": F.coalesce(enough & (F.col("minor_fraction") >= VALUE["barcode_support"]), F.lit(False)),
        }
    )


def select_taxon(support: DataFrame) -> DataFrame:
    """(sample_id, taxon, consistent): the deepest supported taxon of which no callable ancestor is refuted.

    Ties go to more supporting sites, then to natural order. If every supported taxon is refuted by an ancestor, the
    shallowest supported one is taken and marked inconsistent. Samples without a supported taxon have no row.
    """
    supported = support.filter("supported").select("sample_id", "taxon", "supporting")
    above = supported.select("sample_id", "taxon", F.explode(E.taxon_ancestors(F.col("taxon"))).alias("ancestor"))
    refuting = support.filter(~F.col("supported") & (F.col("callable_sites") > 0)).select("sample_id", F.col("taxon").alias("ancestor"))
    refuted = above.join(refuting, ["sample_id", "ancestor"]).select("sample_id", "taxon").distinct().withColumn("refuted", F.lit(True))
    ranked = supported.join(refuted, ["sample_id", "taxon"], "left").withColumn("refuted", F.coalesce("refuted", F.lit(False)))
    depth, name = E.taxon_depth(F.col("taxon")), E.natural_key(F.col("taxon"))
    order = W.partitionBy("sample_id").orderBy(
        "refuted", F.when(F.col("refuted"), depth).otherwise(-depth), F.when(F.col("refuted"), 0).otherwise(-F.col("supporting")), name
    )
    best = ranked.withColumn("i", F.row_number().over(order)).filter("i = 1")
    return best.select("sample_id", "taxon", (~F.col("refuted")).alias("consistent"))


def call_lineages(support: DataFrame) -> DataFrame:
    """One row a sample: lineage, sublineage, sites of the chain, other taxa supported, confidence, BCG and animal flags.

    NULL lineage where no taxon reaches the thresholds. ``mixed`` has supported taxa off the chain, then those with
    minority support only, each in natural order. Confidence: none without a call; with mixed
    support moderate if every callable site of the chain supports it, else low; without, high if moreover every site is
    callable, moderate if the shares reach the thresholds, else low. Animal lineages are moderate at most.
    """
    chosen = select_taxon(support).withColumnRenamed("taxon", "chosen")
    joined = support.join(chosen, "sample_id", "left")
    taxon, pick = F.col("taxon"), F.col("chosen")
    in_chain = (taxon == pick) | F.array_contains(E.taxon_ancestors(pick), taxon)
    below = F.array_contains(E.taxon_ancestors(taxon), pick)
    joined = joined.withColumn("chain", F.coalesce(in_chain & (F.col("consistent") | F.col("supported")), F.lit(False)))
    off = F.col("supported") & ~F.col("chain") & (~F.coalesce(below, F.lit(False)) | ~F.col("consistent"))
    joined = joined.withColumn("off", F.coalesce(off & pick.isNotNull(), F.lit(False)))
    joined = joined.withColumn("minor_off", F.col("minor_supported") & ~F.col("chain") & ~F.col("off") & pick.isNotNull())
    key = E.natural_key(taxon)
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c), F.struct(key.alias("k"), taxon.alias("t"))))), lambda x: x["t"])
    over_chain = lambda c: F.sum(F.when(F.col("chain"), F.col(c)))
    called = joined.groupBy("sample_id").agg(
        F.max("chosen").alias("taxon"),
        F.max("consistent").alias("consistent"),
        over_chain("total").alias("sites_total"),
        over_chain("callable_sites").alias("sites_callable"),
        over_chain("supporting").alias("sites_supporting"),
        F.concat(names("off"), names("minor_off")).alias("mixed"),
    )
    taxon = F.col("taxon")
    root = E.taxon_root(taxon)
    called = called.withColumns(
        {
            "lineage": F.when(taxon.isNotNull(), root),
            "sublineage": F.when(taxon != root, taxon),
            "is_bcg": F.coalesce(F.endswith(taxon, F.lit(BCG_SUFFIX)), F.lit(False)),
            "is_animal": F.coalesce(root.isin(*ANIMAL_ROOTS), F.lit(False)),
        }
    )
    called_share, support_share = E.ratio("sites_callable", "sites_total"), E.ratio("sites_supporting", "sites_callable")
    level = (
        F.when(support_share.isNull(), "none")
        .when(F.size("mixed") > 0, F.when(support_share < 1, "low").otherwise("moderate"))
        .when((called_share >= 1) & (support_share >= 1), "high")
        .when((called_share >= VALUE["barcode_callable"]) & (support_share >= VALUE["barcode_support"]), "moderate")
        .otherwise("low")
    )
    confidence = F.when(F.col("is_animal") & (level == "high"), "moderate").otherwise(level)
    return called.withColumn("confidence", confidence)


def family_of(support: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample_id, family): of the called taxon, or of its nearest ancestor that has one."""
    chain = calls.select("sample_id", F.explode(F.concat(E.taxon_ancestors(F.col("taxon")), F.array("taxon"))).alias("taxon"))
    named = support.filter(F.col("family") != "").select("sample_id", "taxon", "family")
    return chain.join(named, ["sample_id", "taxon"]).groupBy("sample_id").agg(F.max_by("family", E.taxon_depth(F.col("taxon"))).alias("family"))


def call_where_applicable(calls: DataFrame, species: DataFrame, complex_name: str = "MTBC") -> DataFrame:
    """``calls`` with ``applicable``; the lineage of a sample of another complex is NULL. ``species``: sample_id, complex."""
    out = calls.join(species.select("sample_id", "complex"), "sample_id", "left")
    fits = F.coalesce(F.col("complex") == complex_name, F.lit(False))
    keep = lambda c: F.when(fits, F.col(c))
    return out.withColumns({"applicable": fits, "lineage": keep("lineage"), "sublineage": keep("sublineage")})


def scheme_gaps(barcode: DataFrame, members: DataFrame) -> DataFrame:
    """The animal members (member, root) that no taxon of the scheme defines."""
    roots = barcode.select(E.taxon_root(F.col("taxon")).alias("root")).distinct()
    return members.join(roots, "root", "left_anti")
