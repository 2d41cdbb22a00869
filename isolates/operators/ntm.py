"""Drug calls outside the tuberculosis complex, from a small evidence table of ribosomal positions and erm(41)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions import hgvs as H

# The evidence. Positions of rrl and rrs are in E. coli numbering; an empty allele list means any change.
MACROLIDE_POSITIONS = (2058, 2059)
AMIKACIN_POSITIONS = (1408,)
AMIKACIN_NEIGHBOURS = (1406, 1409, 1491)
ERM41_POSITION, ERM41_INDUCIBLE, ERM41_SUSCEPTIBLE = 28, "T", "C"
ERM41_TRUNCATED = 0.80
ORGANISMS = ("ABSCESSUS", "MAC")
EVIDENCE = tuple(
    (organism, drug, gene, position, alleles, call, confidence)
    for organism in ORGANISMS
    for drug, gene, positions, alleles, call, confidence in (
        ("clarithromycin", "rrl", MACROLIDE_POSITIONS, [], "R", "high"),
        ("amikacin", "rrs", AMIKACIN_POSITIONS, ["G"], "R", "high"),
        ("amikacin", "rrs", AMIKACIN_NEIGHBOURS, [], "Uncertain", "low"),
    )
    for position in positions
)
TARGETS = (("ABSCESSUS", "clarithromycin", "erm(41)"), *sorted({(o, d, g) for o, d, g, *_ in EVIDENCE}))
# Names of organisms and drugs that stand for others.
ORGANISM_NAMES = {"mycobacteroides abscessus": "ABSCESSUS", "m. abscessus": "ABSCESSUS", "mycobacterium avium": "MAC", "mycobacterium intracellulare": "MAC", "mycobacterium chimaera": "MAC"}
DRUG_CLASSES = {"azithromycin": "clarithromycin", "macrolide": "clarithromycin", "macrolides": "clarithromycin"}


def evidence_rows(spark: SparkSession) -> DataFrame:
    """(organism, drug, gene, position, alleles, call, confidence)."""
    return spark.createDataFrame(list(EVIDENCE), "organism string, drug string, gene string, position int, alleles array<string>, call string, confidence string")


def targets(spark: SparkSession) -> DataFrame:
    """(organism, drug, gene): the genes that a negative statement about a drug needs."""
    return spark.createDataFrame(list(TARGETS), "organism string, drug string, gene string")


def organism_key(name) -> F.Column:
    known = F.create_map(*[F.lit(x) for pair in ORGANISM_NAMES.items() for x in pair])
    return F.coalesce(F.when(F.upper(name).isin(*ORGANISMS), F.upper(name)), known[F.lower(F.trim(name))])


def resolve_drug(drug) -> F.Column:
    """The drug that evidence is filed under: a class member or class name stands for its representative."""
    low = F.lower(F.trim(drug))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in DRUG_CLASSES.items() for x in pair])[low], low)


def erm41_states(observations: DataFrame) -> DataFrame:
    """(sample_id, state): absent, truncated (body coverage under 0.80), inducible, sequevar-susceptible or not-assessed.

    ``observations``: sample_id, present (NULL if unknown), body_coverage, base at position 28 (NULL if ambiguous).
    """
    state = (
        F.when(~F.col("present"), "absent")
        .when(F.col("body_coverage") < ERM41_TRUNCATED, "truncated")
        .when(F.col("base") == ERM41_INDUCIBLE, "inducible")
        .when(F.col("base") == ERM41_SUSCEPTIBLE, "sequevar-susceptible")
        .otherwise("not-assessed")
    )
    return observations.select("sample_id", state.alias("state"))


def gene_coverage(sites: DataFrame, genes: DataFrame, probes: int = 7, depth: int = 1) -> DataFrame:
    """(sample_id, gene, body_coverage, callable): the share of evenly spaced probes of a gene with reads; callable if all have."""
    step = (F.col("end_pos") - F.col("start_pos")) / (probes - 1)
    spots = genes.select("name", "chrom", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: (F.col("start_pos") + F.round(i * step)).cast("int")))).alias("pos"))
    grid = sites.select("sample_id").distinct().join(F.broadcast(spots), how="cross")
    seen = sites.filter(E.acgt_depth() >= depth).select("sample_id", "chrom", "pos", F.lit(1).alias("seen"))
    held = grid.join(seen, ["sample_id", "chrom", "pos"], "left").groupBy("sample_id", F.col("name").alias("gene"))
    return held.agg(E.ratio(F.count("seen"), F.count("*")).alias("body_coverage"), (F.count("seen") == F.count("*")).alias("callable"))


def call_drugs(samples: DataFrame, variants: DataFrame, erm41: DataFrame, callable_genes: DataFrame, drugs: DataFrame) -> DataFrame:
    """One row for each sample and drug: call, confidence, target_covered, genes not assessed, evidence, and a note.

    ``samples``: sample_id, organism; ``variants``: sample_id, gene, hgvs (n. names), alt; ``erm41``: sample_id, state;
    ``callable_genes``: sample_id, gene, callable; ``drugs``: drug. A listed position with an unlisted allele is
    Uncertain. Anything alarming wins; else a negative genotype speaks, and S with a gene that was not assessed becomes
    no-call. An organism or drug without evidence is refused: no-call, not covered, with a note that says so.
    """
    spark = samples.sparkSession
    asked = samples.select("sample_id", organism_key(F.col("organism")).alias("organism")).join(F.broadcast(drugs.select("drug", resolve_drug(F.col("drug")).alias("filed"))), how="cross")
    rows = evidence_rows(spark)
    placed = variants.withColumn("position", H.nucleotide_position(F.col("hgvs"))).withColumn("base", F.upper(F.regexp_extract("hgvs", r">([A-Za-z])$", 1)))
    placed = placed.join(samples.select("sample_id", organism_key(F.col("organism")).alias("organism")), "sample_id")
    met = placed.join(F.broadcast(rows), ["organism", "gene", "position"])
    listed = (F.size("alleles") == 0) | F.array_contains("alleles", F.col("base"))
    hits = met.select("sample_id", "drug", "gene", F.when(listed, F.col("call")).otherwise("Uncertain").alias("call"), F.when(listed, F.col("confidence")).otherwise("low").alias("confidence"), F.concat("gene", F.lit(" "), "hgvs").alias("evidence"))
    typed = erm41.filter("state <> 'not-assessed'").join(samples.select("sample_id", organism_key(F.col("organism")).alias("organism")), "sample_id").filter("organism = 'ABSCESSUS'")
    inducible = F.col("state") == "inducible"
    hits = hits.union(typed.select("sample_id", F.lit("clarithromycin"), F.lit("erm(41)"), F.when(inducible, "R").otherwise("S"), F.when(inducible, "high").otherwise("moderate"), F.concat(F.lit("erm(41) "), F.col("state"))))
    sev = E.severity(F.col("call"))
    order = W.partitionBy("sample_id", "drug").orderBy(F.desc(F.when(sev > E.severity(F.lit("no-call")), sev + 10).otherwise(sev)), "evidence")
    best = hits.withColumn("i", F.row_number().over(order))
    summed = best.groupBy("sample_id", "drug").agg(F.max(F.when(F.col("i") == 1, F.struct("call", "confidence"))).alias("top"), F.sort_array(F.collect_set("evidence")).alias("evidence"))
    # a gene counts as assessed if it is callable, has a variant of its own, or is erm(41) with a typed state
    done = callable_genes.filter("callable").select("sample_id", "gene").union(variants.select("sample_id", "gene")).union(typed.select("sample_id", F.lit("erm(41)").alias("gene"))).distinct().withColumn("done", F.lit(True))
    need = asked.join(F.broadcast(targets(spark).withColumnRenamed("drug", "filed")), ["organism", "filed"])
    genes = need.join(done, ["sample_id", "gene"], "left").groupBy("sample_id", "drug", "filed").agg(F.sort_array(F.collect_set(F.when(F.col("done").isNull(), F.col("gene")))).alias("missing"), F.count_distinct("gene").alias("genes"))
    out = asked.join(genes, ["sample_id", "drug", "filed"], "left").join(summed.withColumnRenamed("drug", "filed"), ["sample_id", "filed"], "left")
    first, lacking = F.coalesce("top.call", F.lit("no-call")), F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0
    call = F.when(F.col("genes").isNull() | ((first == "S") & lacking), "no-call").otherwise(first)
    note = F.when(F.col("genes").isNull(), "no evidence base for this organism and drug").when(lacking, F.concat(F.lit("not assessed: "), F.array_join("missing", ", "))).otherwise("")
    return out.select(
        "sample_id", "drug", call.alias("call"), F.when(call == "no-call", "none").otherwise(F.coalesce("top.confidence", F.lit("none"))).alias("confidence"),
        F.when(F.col("genes").isNull(), False).otherwise(F.size("missing") < F.col("genes")).alias("target_covered"), "missing", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), note.alias("note"),
    )
