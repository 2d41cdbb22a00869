"""Drug-resistance catalogues: keys, three-route matching, summaries and shape checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions import hgvs as H

ROUTES = ("coordinate", "hgvs", "alias")


def entry_keys(catalogue: DataFrame) -> DataFrame:
    """(entry_id, key, alias_keys): the key of each entry's name and its other spellings."""
    named = catalogue.select("entry_id", "gene", H.normalise(F.col("hgvs")).alias("name"))
    return named.select("entry_id", named_key().alias("key"), H.alias_keys(F.col("gene"), F.col("name"), canonical=True).alias("alias_keys"))


def named_key():
    """The key of a row with gene and normalised name, NULL where either is missing."""
    return F.when((F.col("gene") != "") & (F.col("name") != ""), F.concat("gene", F.lit("_"), "name"))


def match(variants: DataFrame, catalogue: DataFrame, coords: DataFrame) -> DataFrame:
    """(sample_id, variant_id, entry_id, matched_by): catalogue entries of each variant, one row each.

    Routes in order: the exact coordinates (chrom, pos, ref, alt), the key of the variant's name, and, only for variants
    without an entry by either name key or coordinates, an alias on either side. A variant that reaches an entry by
    several routes keeps the first. ``variants``: sample_id, variant_id, chrom, pos, ref, alt, gene, hgvs. A variant's own
    row is joined by equal keys, so Spark may broadcast the catalogue or shuffle both.
    """
    named = variants.withColumn("name", H.normalise(F.col("hgvs"))).withColumn("key", named_key())
    ids = ["sample_id", "variant_id", "entry_id"]
    by_place = named.join(coords.select("entry_id", "chrom", "pos", "ref", "alt"), ["chrom", "pos", "ref", "alt"]).select(*ids, F.lit(0).alias("route"))
    keys = entry_keys(catalogue)
    by_name = named.join(keys.select("entry_id", "key"), "key").select(*ids, F.lit(1).alias("route"))
    direct = by_place.union(by_name)
    rest = named.join(direct.select("sample_id", "variant_id").distinct(), ["sample_id", "variant_id"], "left_anti")
    spelled = keys.select("entry_id", F.explode(F.array_union(F.array("key"), F.col("alias_keys"))).alias("spelling"))
    spellings = F.array_union(F.array("key"), H.alias_keys(F.col("gene"), F.col("name"), canonical=True))
    mine = rest.filter("key is not null").select("sample_id", "variant_id", F.explode(spellings).alias("spelling"))
    by_alias = mine.join(spelled, "spelling").select(*ids, F.lit(2).alias("route"))
    first = direct.union(by_alias).groupBy(*ids).agg(F.min("route").alias("route"))
    return first.select(*ids, F.element_at(F.array(*[F.lit(r) for r in ROUTES]), F.col("route") + 1).alias("matched_by"))


def calls_for(variants: DataFrame, catalogue: DataFrame, coords: DataFrame) -> DataFrame:
    """The matches with the entry's catalogue, drug, grade, call and comment. Rule-only entries never match by a name."""
    entries = catalogue.filter(~F.coalesce("rule_only", F.lit(False))) if "rule_only" in catalogue.columns else catalogue
    found = match(variants, entries, coords)
    return found.join(entries.select("entry_id", "catalogue", "drug", "grade", "call", "comment"), "entry_id")


def multi_graded(catalogue: DataFrame) -> DataFrame:
    """(key, grades): names with different grades for different drugs, as a map from drug to grade."""
    keyed = catalogue.withColumn("key", H.hgvs_key(F.col("gene"), F.col("hgvs"))).groupBy("key", "drug").agg(F.min("grade").alias("grade"))
    out = keyed.groupBy("key").agg(F.count_distinct("grade").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("drug", "grade")))).alias("grades"))
    return out.filter("n > 1").drop("n")


def summary(catalogue: DataFrame) -> DataFrame:
    """One row a catalogue: rows, names, drugs, genes and what share is rule-only."""
    key = H.hgvs_key(F.col("gene"), F.col("hgvs"))
    rule = F.coalesce("rule_only", F.lit(False)) if "rule_only" in catalogue.columns else F.lit(False)
    return catalogue.groupBy("catalogue").agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("names"), F.count_distinct("drug").alias("drugs"), F.count_distinct("gene").alias("genes"), F.count_if(rule).alias("rule_only")
    )


def shape_checks(catalogue: DataFrame, expected: DataFrame) -> DataFrame:
    """Check rows: each catalogue's counts against ``expected`` (catalogue, name, least); a missing catalogue fails."""
    held = summary(catalogue).select("catalogue", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("rows", "names", "drugs", "genes")])).alias("x")).select("catalogue", "x.*")
    out = expected.join(held, ["catalogue", "name"], "left")
    return out.withColumn("status", F.when(F.coalesce("value", F.lit(0)) >= F.col("least"), "pass").otherwise("fail"))


def gene_drugs(catalogue: DataFrame) -> DataFrame:
    """(gene, drugs): the drugs that any entry of a gene is about."""
    return catalogue.groupBy(F.lower("gene").alias("gene")).agg(F.sort_array(F.collect_set("drug")).alias("drugs"))


def union_catalogues(*parts: DataFrame, anchor: str = "WHO") -> DataFrame:
    """All catalogues as one table with entry ids of its own; an error if the anchor is missing."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if out.filter(F.col("catalogue") == anchor).isEmpty():
        raise ValueError(f"no entries of the {anchor} catalogue; it decides every call")
    parts = [c for c in ("catalogue", "drug", "gene", "hgvs", "grade", "call", "chrom", "pos", "ref", "alt") if c in out.columns]
    return out.withColumn("entry_id", F.xxhash64(*parts))


def target_coverage(sites: DataFrame, coords: DataFrame, drugs: DataFrame, samples: DataFrame, depth: int = 10, share: float = 0.95) -> DataFrame:
    """(sample_id, drug, positions, covered, target_covered): whether a drug's catalogued positions were deep enough.

    ``drugs``: entry_id, drug. NULL for a drug without positions; false means that it could not be evaluated.
    """
    wanted = coords.join(drugs, "entry_id").select("drug", "chrom", "pos").distinct()
    named = samples.select("sample_id").distinct().join(F.broadcast(drugs.select("drug").distinct()), how="cross")
    deep = sites.filter(E.acgt_depth() >= depth).select("sample_id", "chrom", "pos")
    per_drug = wanted.groupBy("drug").agg(F.count("*").alias("positions"))
    covered = deep.join(wanted, ["chrom", "pos"]).groupBy("sample_id", "drug").agg(F.count("*").alias("covered"))
    out = named.join(per_drug, "drug", "left").join(covered, ["sample_id", "drug"], "left")
    out = out.withColumn("covered", F.when(F.col("positions").isNotNull(), F.coalesce("covered", F.lit(0))))
    return out.withColumn("target_covered", E.ratio("covered", "positions") >= share)
