"""Drug calls: additional grading rules, epistasis, suppression, and the three-catalogue consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import drugs as D
from isolates.functions import expressions as E
from isolates.functions import hgvs as H
from isolates.functions.thresholds import VALUE

ANCHOR = "WHO"
# Gene and drug whose calls are artefacts on ONT; epistasis (suppressor, suppressed, region, drugs).
ONT_SUPPRESSED = (("fbic", "delamanid"),)
EPISTASIS = (("mmpL5", "Rv0678", None, ("bedaquiline", "clofazimine")), ("eis", "eis", "promoter", ("amikacin", "kanamycin")))
CONFIDENCE_FOR_GRADE = {1: "high", 2: "moderate", 3: "low", 4: "moderate", 5: "high"}


def platform_filters(variants: DataFrame, platform: str) -> DataFrame:
    """``variants`` with reasons added to ``filters`` (nothing is removed) and ``is_major`` filled in.

    Fewer alternative reads than the platform's floor, or a fraction under the minor floor; a missing value adds no reason.
    """
    from isolates.functions.thresholds import min_reads

    few = F.when(F.col("alt_reads") < min_reads(platform), "min_reads")
    low = F.when(F.col("allele_fraction") < VALUE["min_minor_fraction"], "min_fraction")
    added = F.array_compact(F.array(few, low))
    return variants.withColumn("filters", F.array_union(F.coalesce("filters", F.array().cast("array<string>")), added)).withColumn(
        "is_major", F.col("allele_fraction") >= VALUE["major_variant_fraction"]
    )


def rule_calls(variants: DataFrame, graded: DataFrame, gene_drugs: DataFrame) -> DataFrame:
    """(sample_id, variant_id, drug, grade, call, rule): grades by rule for drugs that the anchor does not grade.

    Borderline rpoB changes are 1, other changes in its resistance region 2, loss of function in a listed gene 2, and a
    silent change 4 for the drugs of its gene. ``graded``: sample_id, variant_id, drug; ``gene_drugs``: gene, drugs.
    """
    variants = variants.withColumn("__name", H.normalise(F.col("hgvs")))
    gene, name = F.col("gene"), F.col("__name")
    loss = H.is_loss_of_function(name, F.col("effect"))

    def hit(condition: Column, drug: str, grade: int, rule: str) -> Column:
        return F.when(condition, F.struct(F.lit(drug).alias("drug"), F.lit(grade).alias("grade"), F.lit(rule).alias("rule")))

    borderline = H.is_borderline(gene, name)
    hits = [hit(borderline, H.RRDR_DRUG, 1, "rpob-borderline"), hit(~borderline & H.in_rrdr(gene, name) & ~H.is_synonymous(name), H.RRDR_DRUG, 2, "rpob-rrdr")]
    hits += [hit(loss & gene.isin(*genes), drug, 2, "loss-of-function") for drug, genes in H.LOSS_GENES.items()]
    fixed = variants.select("sample_id", "variant_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("sample_id", "variant_id", "h.*")
    silent = variants.filter(H.is_synonymous(name)).withColumn("g", F.lower("gene")).join(gene_drugs.withColumnRenamed("gene", "g"), "g")
    silent = silent.select("sample_id", "variant_id", F.explode("drugs").alias("drug"), F.lit(4).alias("grade"), F.lit("silent").alias("rule"))
    found = fixed.union(silent).distinct().join(graded.select("sample_id", "variant_id", "drug").distinct(), ["sample_id", "variant_id", "drug"], "left_anti")
    return found.withColumn("call", E.call_for_grade(F.col("grade")))


def epistasis(variants: DataFrame) -> DataFrame:
    """(sample_id, rule, drug, variant_id, confident): variants whose effect a loss of function in the same sample removes.

    Not confident where suppressor and suppressed are not both major or both minor: they may sit in different
    subpopulations, and such a rule is reported but not applied.
    """
    name = H.normalise(F.col("hgvs"))
    marked = variants.select(
        "sample_id", "variant_id", F.lower("gene").alias("gene"), H.is_promoter(name).alias("promoter"),
        (H.is_loss_of_function(name, F.col("effect")) & ~H.is_promoter(name)).alias("lost"),
        (F.col("allele_fraction") >= VALUE["major_variant_fraction"]).alias("major"),
    )
    out = None
    for by, of, region, drugs in EPISTASIS:
        rule = f"epistasis:{by}-lof-abrogates-{of}{'-' + region if region else ''}"
        first = marked.filter(F.col("lost") & (F.col("gene") == by.lower())).groupBy("sample_id").agg(F.bool_and("major").alias("all_major"), F.bool_or("major").alias("any_major"))
        target = marked.filter(F.col("gene") == of.lower())
        target = target.filter("promoter") if region == "promoter" else target
        if by.lower() == of.lower() and region is None:
            target = target.filter(~F.col("lost"))
        met = target.join(first, "sample_id")
        clash = (F.col("major") & ~F.col("all_major")) | (~F.col("major") & F.col("any_major"))
        per_sample = W.partitionBy("sample_id")
        met = met.withColumn("confident", ~F.coalesce(F.bool_or(clash).over(per_sample), F.lit(False)))
        part = met.select("sample_id", F.lit(rule).alias("rule"), F.explode(F.array(*[F.lit(d) for d in drugs])).alias("drug"), "variant_id", "confident")
        out = part if out is None else out.union(part)
    return out


def contributions(calls: DataFrame, variants: DataFrame, platform: str, suppressed: DataFrame | None = None) -> DataFrame:
    """Every catalogue call with its variant and ``suppressed_by``: thresholds first, then epistasis, then the platform.

    ``calls``: sample_id, variant_id, catalogue, drug, grade, call, matched_by. Nothing is dropped.
    """
    kept = variants.select("sample_id", "variant_id", "chrom", "pos", "ref", "alt", "gene", "filters", "is_major")
    out = calls.withColumn("drug", D.drug_name(F.col("drug"))).join(kept, ["sample_id", "variant_id"])
    below = F.when(~E.passes(F.col("filters")), F.concat(F.lit("below platform thresholds ("), F.array_join("filters", ", "), F.lit(")")))
    by_rule = F.lit(None).cast("string")
    if suppressed is not None:
        rules = suppressed.filter("confident").groupBy("sample_id", "variant_id", "drug").agg(F.min("rule").alias("__rule"))
        out = out.join(rules, ["sample_id", "variant_id", "drug"], "left")
        by_rule = F.col("__rule")
    artefact = F.lit(None).cast("string")
    if platform == "ont":
        pair = F.concat_ws("|", F.lower("gene"), "drug")
        artefact = F.when(pair.isin(*["|".join(x) for x in ONT_SUPPRESSED]), "platform:ont")
    return out.withColumn("suppressed_by", F.coalesce(below, by_rule, artefact)).drop("__rule")


def stance(call: Column) -> Column:
    return F.when(E.is_resistant(call), "resistant").when(call.isin("S", "S-interim"), "not-resistant").when(call == "Uncertain", "uncertain")


def consensus(parts: DataFrame, platform: str, covered: DataFrame | None = None) -> DataFrame:
    """One row for each sample and drug that anything is said about.

    The anchor catalogue's worst active call decides; if it is silent, a resistant call of another becomes
    R-outside-WHO, else the worst other call stands, else no-call. A resistant call that was suppressed turns what is not
    resistant into Uncertain. Catalogues disagree if those that spoke take different stances; the kind is coverage
    (target not covered, or all positions masked), nomenclature (one coordinate, several names or an alias) or
    biological. Confidence comes from the anchor's grade and is lowered by disagreement and, on ONT, by an indel.
    ``covered``: sample_id, drug, target_covered; false means that the drug could not be evaluated. ``level`` and
    ``cross_resistance`` come from the comments of counted resistant calls (column comment), the highest level first;
    ``caveats`` are the platform's, then those of suppression and missing cover.
    """
    sev = E.severity(F.col("call"))
    active = F.col("suppressed_by").isNull()
    speaks = active & (F.col("call") != "no-call")
    anchored = F.col("catalogue") == ANCHOR
    marked = parts.withColumns(
        {
            "sev": sev, "active": active, "speaks": speaks, "anchored": anchored,
            "variant_key": H.hgvs_key(F.col("gene"), F.col("hgvs")) if "hgvs" in parts.columns else F.col("variant_id"),
            "coordinate": E.coordinate_key(), "indel": F.length("ref") != F.length("alt"), "resistant": E.is_resistant(F.col("call")),
        }
    )
    for name, kind in (("comment", "string"), ("is_major", "boolean")):
        if name not in marked.columns:
            marked = marked.withColumn(name, F.lit(None).cast(kind))
    if "masked" not in marked.columns:
        marked = marked.withColumn("masked", F.lit(False))
    # what each catalogue says is its worst call, then its position
    said = marked.filter("speaks").groupBy("sample_id", "drug", "catalogue").agg(F.max_by("call", "sev").alias("headline"))
    stances = said.groupBy("sample_id", "drug").agg((F.count_distinct(stance(F.col("headline"))) > 1).alias("disagreement"))
    has_stance = F.col("active") & stance(F.col("call")).isNotNull()
    per = marked.groupBy("sample_id", "drug").agg(
        F.max_by(F.when(F.col("speaks") & F.col("anchored"), F.struct("call", "grade")), F.when(F.col("speaks") & F.col("anchored"), F.col("sev"))).alias("anchor"),
        F.bool_or(F.col("speaks") & ~F.col("anchored") & F.col("resistant")).alias("other_resistant"),
        F.max_by(F.when(F.col("speaks") & ~F.col("anchored"), F.col("call")), F.when(F.col("speaks") & ~F.col("anchored"), F.col("sev"))).alias("other"),
        F.bool_or(~F.col("active") & F.col("resistant")).alias("lost_resistance"),
        F.bool_or(~F.col("active")).alias("any_suppressed"),
        F.bool_or(F.col("active") & F.col("indel")).alias("indel"),
        F.bool_or(F.col("active") & ~F.col("is_major")).alias("minor"),
        F.array_sort(F.collect_set(F.when(F.col("speaks") & F.col("resistant"), D.level_stated(F.col("comment"))))).alias("levels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("speaks") & F.col("resistant"), D.cross_resistance(F.col("comment"), F.col("drug"))))))).alias("cross_resistance"),
        F.bool_and(F.when(has_stance, F.col("masked"))).alias("all_masked"),
        F.count_distinct(F.when(has_stance, F.col("coordinate"))).alias("coordinates"),
        F.count_distinct(F.when(has_stance, F.col("variant_key"))).alias("names"),
        F.bool_or(has_stance & (F.col("matched_by") == "alias")).alias("aliased"),
        F.sort_array(F.collect_set(F.when(F.col("speaks"), F.col("variant_key")))).alias("supporting_variants"),
        F.array_join(F.sort_array(F.collect_set("suppressed_by")), "; ").alias("suppressed_by"),
    )
    per = per.join(stances, ["sample_id", "drug"], "left").withColumn("disagreement", F.coalesce("disagreement", F.lit(False)))
    per = per.join(covered.select("sample_id", "drug", "target_covered"), ["sample_id", "drug"], "left") if covered is not None else per.withColumn("target_covered", F.lit(None).cast("boolean"))
    call = F.coalesce(F.col("anchor.call"), F.when(F.col("other_resistant"), "R-outside-WHO"), F.col("other"), F.lit("no-call"))
    call = F.when(F.col("lost_resistance") & ~E.is_resistant(call), "Uncertain").otherwise(call)
    per = per.withColumn("call", call)
    graded = F.coalesce(F.create_map(*[F.lit(x) for pair in CONFIDENCE_FOR_GRADE.items() for x in pair])[F.col("anchor.grade").cast("int")], F.lit("low"))
    base = (
        F.when(F.col("target_covered").eqNullSafe(False) | (F.col("call") == "no-call"), "none")
        .when(F.col("call") == "R-outside-WHO", "low")
        .when((F.col("call") == "Uncertain") & F.col("any_suppressed"), "low")
        .otherwise(graded)
    )
    steps = F.col("disagreement").cast("int")
    if platform == "ont":
        steps = steps + (F.col("indel") & E.is_resistant(F.col("call"))).cast("int")
    kind = (
        F.when(~F.col("disagreement"), "none")
        .when(F.col("target_covered").eqNullSafe(False) | F.coalesce("all_masked", F.lit(False)), "coverage")
        .when((F.col("coordinates") == 1) & ((F.col("names") > 1) | F.col("aliased")), "nomenclature")
        .otherwise("biological")
    )
    return per.select(
        "sample_id", "drug", "call", E.downgrade(base, steps).alias("confidence"), "disagreement", kind.alias("disagreement_kind"),
        F.col("anchor").isNotNull().alias("who_graded"), F.col("anchor.grade").alias("who_grade"), "supporting_variants", "suppressed_by", "target_covered",
        F.coalesce(*[F.when(F.array_contains("levels", x), x) for x in ("high-level", "additive low-level", "low-level")]).alias("level"), "cross_resistance",
        F.array_distinct(F.concat(
            D.caveats(platform, E.is_resistant(F.col("call")), F.col("indel"), F.col("minor")),
            F.array_compact(F.array(F.when(F.col("any_suppressed"), "suppressed-evidence"), F.when(F.col("target_covered").eqNullSafe(False), "target-not-covered"))),
        )).alias("caveats"),
    )


def complete_panel(calls: DataFrame, samples: DataFrame, panel: DataFrame) -> DataFrame:
    """``calls`` with a no-call row for every sample and drug of the panel that nothing was said about."""
    grid = samples.select("sample_id").distinct().join(F.broadcast(panel.select("drug").distinct()), how="cross")
    out = grid.join(calls, ["sample_id", "drug"], "full")
    return out.withColumns(
        {
            "call": F.coalesce("call", F.lit("no-call")),
            "confidence": F.coalesce("confidence", F.lit("none")),
            "disagreement": F.coalesce("disagreement", F.lit(False)),
            "disagreement_kind": F.coalesce("disagreement_kind", F.lit("none")),
            "who_graded": F.coalesce("who_graded", F.lit(False)),
        }
    )


def annex_rows(parts: DataFrame) -> DataFrame:
    """Every catalogue call beside its variant, and whether it counted."""
    return parts.select(
        "sample_id", "drug", "catalogue", "variant_id", E.coordinate_key().alias("coordinate"), "grade", "call", "matched_by", "suppressed_by", F.col("suppressed_by").isNull().alias("counted")
    )
