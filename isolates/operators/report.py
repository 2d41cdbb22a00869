"""Flat report views over calls, variants, checks and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E

CATALOGUES = ("WHO", "flat", "third")


def drug_rows(calls: DataFrame, parts: DataFrame, catalogues: tuple[str, ...] = CATALOGUES) -> DataFrame:
    """Each drug call beside what every catalogue says: its worst counted call, or not-consulted where it has no row."""
    sev = F.when(F.col("suppressed_by").isNull() & (F.col("call") != "no-call"), E.severity(F.col("call")))
    said = parts.groupBy("sample_id", "drug").agg(*[F.max_by(F.when(F.col("catalogue") == c, F.col("call")), F.when(F.col("catalogue") == c, sev)).alias(f"call_{c}") for c in catalogues])
    out = calls.join(said, ["sample_id", "drug"], "left")
    return out.withColumns({f"call_{c}": F.coalesce(f"call_{c}", F.lit("not-consulted")) for c in catalogues})


def determinants(supporting: Column, shown: int = 4) -> Column:
    """The first few names, and how many more there are."""
    rest = F.size(supporting) - shown
    return F.concat(F.array_join(F.slice(supporting, 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def drug_flags(calls: DataFrame) -> DataFrame:
    """``calls`` with ``flags``: disagreement, suppressed and not-covered, as far as they apply."""
    c = F.col
    return calls.withColumn(
        "flags",
        F.array_compact(F.array(F.when(c("disagreement"), F.concat(F.lit("disagreement:"), c("disagreement_kind"))), F.when(F.coalesce("suppressed_by", F.lit("")) != "", "suppressed"), F.when(c("target_covered").eqNullSafe(False), "not-covered"))),
    )


def disagreement_rows(calls: DataFrame) -> DataFrame:
    return calls.filter("disagreement").select("sample_id", "drug", "call", "disagreement_kind", "supporting_variants")


def drug_grid(calls: DataFrame, drugs: list[str]) -> DataFrame:
    """One row a sample, one column for each drug of a stated panel; the panel fixes the columns, so nothing is collected."""
    return calls.groupBy("sample_id").pivot("drug", drugs).agg(F.first("call"))


def variant_rows(variants: DataFrame, parts: DataFrame) -> DataFrame:
    """``variants`` with the worst call that any catalogue gives and the grades by catalogue, as ``catalogue:drug=grade``."""
    said = parts.groupBy("sample_id", "variant_id").agg(
        F.max_by("call", E.severity(F.col("call"))).alias("worst_call"),
        F.array_join(F.sort_array(F.collect_set(F.concat("catalogue", F.lit(":"), "drug", F.lit("="), F.col("grade").cast("string")))), ";").alias("grades"),
    )
    return variants.join(said, ["sample_id", "variant_id"], "left")


def graded_rows(variants: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each variant, catalogue and drug: the grading table in full, with the variant's depth and fraction."""
    held = variants.select("sample_id", "variant_id", "chrom", "pos", "depth", F.round("allele_fraction", 4).alias("allele_fraction"))
    said = parts.select("sample_id", "variant_id", "catalogue", "drug", F.col("grade").cast("string").alias("grade"), "call", "matched_by")
    return held.join(said, ["sample_id", "variant_id"])


def plot_points(variants: DataFrame, parts: DataFrame, calls: DataFrame) -> DataFrame:
    """``variants`` for a plot: the worst call that they support, else the worst that a catalogue gives them, else no-call.

    Variants without a fraction stay. ``calls``: sample_id, drug, call, supporting_variants (names of variants).
    """
    worst = lambda: F.max_by("call", E.severity(F.col("call")))
    said = parts.groupBy("sample_id", "variant_id").agg(worst().alias("catalogue_call"), F.sort_array(F.collect_set("drug")).alias("drugs"))
    driven = calls.select("sample_id", "call", F.explode("supporting_variants").alias("variant_id")).groupBy("sample_id", "variant_id").agg(worst().alias("driven"))
    out = variants.join(said, ["sample_id", "variant_id"], "left").join(driven, ["sample_id", "variant_id"], "left")
    none = F.lit("no-call")
    return out.select(
        "sample_id", "variant_id", "chrom", "pos", "allele_fraction", "depth", F.coalesce("driven", "catalogue_call", none).alias("call"), F.coalesce("catalogue_call", none).alias("catalogue_call"),
        F.col("catalogue_call").isNotNull().alias("catalogued"), F.coalesce("drugs", F.array().cast("array<string>")).alias("drugs"),
    )


def unverified_rows(thresholds: DataFrame) -> DataFrame:
    """Thresholds that rest on policy alone, or that were overridden: what a reader has to know of."""
    return thresholds.filter(~F.col("verified") | F.col("overridden")).select("name", "value", "unit", "source", F.when(F.col("overridden"), "overridden").otherwise("unverified").alias("why"))


def panel(checks: DataFrame, spec: DataFrame) -> DataFrame:
    """Every metric of a spec (name, label, ordinal) for every sample, measured or not."""
    samples = checks.select("sample_id").distinct()
    grid = samples.join(F.broadcast(spec), how="cross")
    out = grid.join(checks.select("sample_id", "name", "value", "status", "measured"), ["sample_id", "name"], "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("warn")), "measured": F.coalesce("measured", F.lit(False))})


def distance_rows(pairs: DataFrame, members: DataFrame, threshold: int, floor: int) -> DataFrame:
    """``pairs`` with within (NULL without a distance), sufficient and same_cluster."""
    a = members.select(F.col("sample_id").alias("sample_a"), F.col("cluster_id").alias("__a"))
    b = members.select(F.col("sample_id").alias("sample_b"), F.col("cluster_id").alias("__b"))
    out = pairs.join(a, "sample_a", "left").join(b, "sample_b", "left")
    return out.withColumns(
        {
            "within": F.col("snps") <= threshold,
            "sufficient": F.coalesce(F.col("shared_callable_sites") >= floor, F.lit(False)),
            "same_cluster": F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)),
        }
    ).drop("__a", "__b")


def distance_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The square matrix over stated samples; the diagonal is 0, a pair without a distance is NULL."""
    both = pairs.select("sample_a", "sample_b", "snps").union(pairs.select("sample_b", "sample_a", "snps"))
    return both.groupBy(F.col("sample_a").alias("sample_id")).pivot("sample_b", names).agg(F.first("snps")).select(
        "sample_id", *[F.when(F.col("sample_id") == n, F.lit(0)).otherwise(F.col(n)).alias(n) for n in names]
    )


def cohort_summary(lineages: DataFrame, validity: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a sample: lineage, verdict by use, resistant drugs and a headline sentence."""
    uses = validity.groupBy("sample_id").pivot("use", ["resistance", "transmission"]).agg(F.first("verdict"))
    resistant = calls.groupBy("sample_id").agg(F.sort_array(F.collect_set(F.when(E.is_resistant(F.col("call")), F.col("drug")))).alias("resistant_drugs"))
    out = lineages.select("sample_id", "lineage", "confidence").join(uses, "sample_id", "left").join(resistant, "sample_id", "left")
    said = F.when(F.size("resistant_drugs") > 0, F.concat(F.lit("resistance predicted to "), F.array_join("resistant_drugs", ", "))).otherwise("no resistance determinant counted")
    return out.withColumn("headline", F.concat(F.coalesce("lineage", F.lit("lineage not determined")), F.lit("; "), said, F.lit("; "), F.coalesce("resistance", F.lit("not-assessed")), F.lit(" for resistance")))


def in_display_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``rows`` of drugs with ``place``: the order table's (drug, ordinal) first, the others after by name."""
    out = rows.join(F.broadcast(order), "drug", "left")
    keys = W.partitionBy("sample_id").orderBy(F.asc_nulls_last("ordinal"), E.natural_key(F.col("drug")))
    return out.withColumn("place", F.row_number().over(keys)).drop("ordinal")
