"""Registered queries on variants, catalogues, drug calls and cohorts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.operators import catalogue as K
from isolates.operators import cohort as H
from isolates.operators import resistance as R
from isolates.plans.fixtures import run_sql, view, with_sql
from isolates.plans.typing_queries import _MASK, _REGIONS, mask, regions
from isolates.session import materialise

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of the view as the operators take them, filtered for the platform."""
    raw = view(spark, sf_dir, "variants").withColumns(
        {"gene": F.lit(""), "hgvs": F.lit(""), "effect": F.lit(""), "allele_fraction": E.ratio("alt_reads", "depth"), "filters": F.when(F.col("flag") == 0, F.array(F.lit("LowQual"))).otherwise(F.array(F.lit("PASS")))}
    )
    return R.platform_filters(raw, "illumina")


_VARIANTS = """
 v AS (SELECT sample_id, variant_id, chrom, pos, ref, alt, alt_reads, depth, alt_reads * 1.0 / depth AS af, flag,
         CONCAT_WS(',', CASE WHEN flag = 0 THEN 'LowQual' ELSE 'PASS' END, CASE WHEN alt_reads < 3 THEN 'min_reads' END, CASE WHEN alt_reads * 1.0 / depth < 0.05 THEN 'min_fraction' END) AS filters,
         flag <> 0 AND alt_reads >= 3 AND alt_reads * 1.0 / depth >= 0.05 AS pass, alt_reads * 1.0 / depth >= 0.9 AS major
  FROM variants)"""


@query("variant_filters", with_sql(" SELECT sample_id, variant_id, ROUND(af, 6) AS allele_fraction, filters, pass AS passing, major AS is_major, 'snp' AS variant_type FROM v", _VARIANTS))
def variant_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variants(spark, sf_dir)
    return out.select(
        "sample_id", "variant_id", F.round("allele_fraction", 6).alias("allele_fraction"), F.array_join("filters", ",").alias("filters"), E.passes(F.col("filters")).alias("passing"), "is_major", E.variant_type(F.col("ref"), F.col("alt")).alias("variant_type")
    )


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = view(spark, sf_dir, "catalogue")
    named = entries.select("entry_id", "catalogue", "drug", "gene", F.concat(F.lit("c."), F.col("pos").cast("string"), F.lit("A>"), "alt").alias("hgvs"), "grade", "call", F.lit("").alias("comment"))
    return named, entries.select("entry_id", "chrom", "pos", "ref", "alt")


_MATCHED = (
    _VARIANTS
    + """,
 matched AS (SELECT v.*, k.entry_id, k.catalogue, k.drug, k.gene, k.grade, k.call FROM v JOIN catalogue k ON k.chrom = v.chrom AND k.pos = v.pos AND k.ref = v.ref AND k.alt = v.alt)"""
)


@query("catalogue_matches", with_sql(" SELECT sample_id, variant_id, entry_id, 'coordinate' AS matched_by FROM matched", _MATCHED))
def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, coords = _catalogue(spark, sf_dir)
    return K.match(variants(spark, sf_dir), entries, coords).select("sample_id", "variant_id", "entry_id", "matched_by")


_CONSENSUS = (
    _MATCHED
    + """,
 parts AS (SELECT *, CASE call WHEN 'S' THEN 0 WHEN 'S-interim' THEN 1 WHEN 'Uncertain' THEN 3 WHEN 'R-interim' THEN 4 ELSE 6 END AS sev,
   CASE WHEN call IN ('R', 'R-interim') THEN 'resistant' WHEN call IN ('S', 'S-interim') THEN 'not-resistant' ELSE 'uncertain' END AS stance,
   CASE WHEN NOT pass THEN CONCAT('below platform thresholds (', REPLACE(filters, ',', ', '), ')') END AS suppressed FROM matched),
 headline AS (SELECT sample_id, drug, catalogue, MAX(sev) AS sev FROM parts WHERE pass GROUP BY ALL),
 dis AS (SELECT sample_id, drug, COUNT(DISTINCT CASE WHEN sev >= 4 THEN 'r' WHEN sev <= 1 THEN 's' ELSE 'u' END) > 1 AS disagreement FROM headline GROUP BY sample_id, drug),
 per AS (SELECT sample_id, drug, MAX(CASE WHEN pass AND catalogue = 'WHO' THEN sev END) AS who, MAX(CASE WHEN pass AND catalogue <> 'WHO' THEN sev END) AS other,
   MAX(CASE WHEN NOT pass AND sev >= 4 THEN 1 ELSE 0 END) AS lost, MAX(CASE WHEN NOT pass THEN 1 ELSE 0 END) AS any_suppressed,
   COUNT(DISTINCT CASE WHEN pass THEN variant_id END) AS coordinates, STRING_AGG(DISTINCT CASE WHEN pass THEN variant_id END, ',' ORDER BY CASE WHEN pass THEN variant_id END) AS supporting_variants,
   STRING_AGG(DISTINCT suppressed, '; ' ORDER BY suppressed) AS suppressed_by FROM parts GROUP BY sample_id, drug),
 first AS (SELECT p.*, COALESCE(d.disagreement, FALSE) AS disagreement,
   CASE WHEN who IS NOT NULL THEN CASE who WHEN 0 THEN 'S' WHEN 1 THEN 'S-interim' WHEN 3 THEN 'Uncertain' WHEN 4 THEN 'R-interim' ELSE 'R' END
        WHEN other >= 4 THEN 'R-outside-WHO' WHEN other IS NOT NULL THEN CASE other WHEN 0 THEN 'S' WHEN 1 THEN 'S-interim' ELSE 'Uncertain' END ELSE 'no-call' END AS c0
   FROM per p LEFT JOIN dis d USING (sample_id, drug)),
 decided AS (SELECT *, CASE WHEN lost = 1 AND c0 NOT LIKE 'R%' THEN 'Uncertain' ELSE c0 END AS call FROM first),
 graded AS (SELECT *, CASE WHEN call = 'no-call' THEN 3 WHEN call = 'R-outside-WHO' THEN 2 WHEN call = 'Uncertain' AND any_suppressed = 1 THEN 2
   WHEN who IS NULL THEN 2 WHEN who IN (6, 0) THEN 0 WHEN who IN (4, 1) THEN 1 ELSE 2 END AS conf FROM decided)"""
)


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, coords = _catalogue(spark, sf_dir)
    found = variants(spark, sf_dir)
    return R.contributions(K.calls_for(found, entries, coords), found, "illumina")


@query(
    "drug_consensus",
    with_sql(
        """
 SELECT sample_id, drug, call, CASE LEAST(conf + CASE WHEN disagreement THEN 1 ELSE 0 END, 3) WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
        disagreement, CASE WHEN disagreement THEN 'biological' ELSE 'none' END AS disagreement_kind, who IS NOT NULL AS who_graded,
        CASE who WHEN 6 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 1 THEN 4 WHEN 0 THEN 5 END AS who_grade, COALESCE(supporting_variants, '') AS supporting_variants, COALESCE(suppressed_by, '') AS suppressed_by
 FROM graded""",
        _CONSENSUS,
    ),
)
def drug_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consensus(contributions(spark, sf_dir), "illumina").drop("target_covered", "level", "cross_resistance", "caveats").withColumn("supporting_variants", F.array_join("supporting_variants", ","))


@query("annex_rows", with_sql(" SELECT sample_id, drug, catalogue, variant_id, variant_id AS coordinate, grade, call, 'coordinate' AS matched_by, suppressed AS suppressed_by, pass AS counted FROM parts", _CONSENSUS))
def annex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annex_rows(contributions(spark, sf_dir))


@query(
    "drug_panel",
    with_sql(
        """
 SELECT s.sample_id, p.drug, COALESCE(d.call, 'no-call') AS call FROM (SELECT DISTINCT sample_id FROM sites) s CROSS JOIN (SELECT DISTINCT drug FROM catalogue WHERE catalogue = 'WHO') p
 LEFT JOIN decided d ON d.sample_id = s.sample_id AND d.drug = p.drug""",
        _CONSENSUS,
    ),
)
def drug_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "catalogue").filter("catalogue = 'WHO'").select("drug").distinct()
    calls = R.consensus(contributions(spark, sf_dir), "illumina").join(panel, "drug", "left_semi")
    return R.complete_panel(calls, view(spark, sf_dir, "sites"), panel).select("sample_id", "drug", "call")


@query("multi_graded", with_sql(" SELECT gene || '_c.' || pos || 'A>' || alt AS key, COUNT(DISTINCT grade) AS grades FROM (SELECT gene, pos, alt, drug, MIN(grade) AS grade FROM catalogue GROUP BY ALL) g GROUP BY gene, pos, alt HAVING COUNT(DISTINCT grade) > 1"))
def multi_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.multi_graded(_catalogue(spark, sf_dir)[0])
    return out.select("key", F.size(F.array_distinct(F.map_values("grades"))).cast("long").alias("grades"))


@query("catalogue_summary", with_sql(" SELECT catalogue, COUNT(*) AS rows, COUNT(DISTINCT gene || '_' || pos || alt) AS names, COUNT(DISTINCT drug) AS drugs, COUNT(DISTINCT gene) AS genes FROM catalogue GROUP BY catalogue"))
def catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(_catalogue(spark, sf_dir)[0]).drop("rule_only")


@query("gene_drugs", with_sql(" SELECT LOWER(gene) AS gene, STRING_AGG(DISTINCT drug, ',' ORDER BY drug) AS drugs FROM catalogue GROUP BY LOWER(gene)"))
def gene_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gene_drugs(view(spark, sf_dir, "catalogue")).withColumn("drugs", F.array_join("drugs", ","))


@query(
    "target_coverage",
    with_sql(
        """
 SELECT s.sample_id, w.drug, COUNT(*) AS positions, COUNT(d.pos) AS covered, COUNT(d.pos) * 1.0 / COUNT(*) >= 0.95 AS target_covered
 FROM (SELECT DISTINCT sample_id FROM sites) s CROSS JOIN (SELECT DISTINCT drug, chrom, pos FROM catalogue) w
 LEFT JOIN depths d ON d.sample_id = s.sample_id AND d.chrom = w.chrom AND d.pos = w.pos AND d.depth >= 10 GROUP BY s.sample_id, w.drug"""
    ),
)
def target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, coords = _catalogue(spark, sf_dir)
    sites = view(spark, sf_dir, "sites")
    return K.target_coverage(sites, coords, entries.select("entry_id", "drug"), sites)


_JOINT = (
    _VARIANTS
    + ","
    + _REGIONS
    + ","
    + _MASK
    + """,
 joint AS (SELECT sample_id, chrom, pos, CASE WHEN major THEN alt ELSE 'N' END AS allele FROM v WHERE pass),
 spots AS (SELECT DISTINCT chrom, pos FROM joint)"""
)


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.usable_variants(variants(spark, sf_dir))


@query(
    "joint_table",
    with_sql(
        """
 SELECT p.chrom, p.pos, 'A' AS ref, TRUE AS is_snp, s.sample_id, COALESCE(j.allele, CASE WHEN d.pos IS NOT NULL THEN 'A' ELSE '?' END) AS allele
 FROM spots p CROSS JOIN (SELECT DISTINCT sample_id FROM sites) s LEFT JOIN joint j ON j.sample_id = s.sample_id AND j.chrom = p.chrom AND j.pos = p.pos
 LEFT JOIN deep d ON d.sample_id = s.sample_id AND d.chrom = p.chrom AND d.pos = p.pos""",
        _JOINT,
    ),
)
def joint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.joint_table(_joint(spark, sf_dir), regions(spark, sf_dir), view(spark, sf_dir, "sites"))


_PAIRS = (
    _JOINT
    + """,
 names AS (SELECT DISTINCT sample_id FROM sites),
 kept AS (SELECT * FROM deep d WHERE NOT EXISTS (SELECT 1 FROM mask_points m WHERE m.chrom = d.chrom AND m.p = d.pos - 1)),
 here AS (SELECT k.sample_id, k.chrom, k.pos, COALESCE(j.allele, 'A') AS allele, j.allele IS NOT NULL AS departs FROM kept k JOIN spots USING (chrom, pos) LEFT JOIN joint j USING (sample_id, chrom, pos)),
 met AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.chrom, a.pos, a.allele AS x, b.allele AS y, a.allele = 'N' OR b.allele = 'N' AS unclear
   FROM here a JOIN here b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id WHERE a.departs OR b.departs),
 near AS (SELECT *, COALESCE(pos - LAG(pos) OVER w <= 12, FALSE) OR COALESCE(LEAD(pos) OVER w - pos <= 12, FALSE) AS close FROM met WINDOW w AS (PARTITION BY sample_a, sample_b, chrom, unclear ORDER BY pos)),
 counted AS (SELECT sample_a, sample_b, SUM(CASE WHEN unclear THEN 1 ELSE 0 END) AS amb, SUM(CASE WHEN NOT unclear AND x <> y AND NOT close THEN 1 ELSE 0 END) AS snps FROM near GROUP BY sample_a, sample_b),
 common AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, COUNT(*) AS n FROM deep a JOIN deep b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id GROUP BY ALL),
 clean AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, COUNT(*) AS n FROM kept a JOIN kept b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id GROUP BY ALL),
 pairs AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, CAST(COALESCE(c.snps, 0) AS BIGINT) AS snps, CAST(COALESCE(k.n, 0) - COALESCE(c.amb, 0) AS BIGINT) AS shared_callable_sites,
   CAST(COALESCE(m.n, 0) - COALESCE(k.n, 0) AS BIGINT) AS masked_sites, CAST(0 AS BIGINT) AS indel_sites, CAST(COALESCE(c.amb, 0) AS BIGINT) AS ambiguous_sites
   FROM names a JOIN names b ON a.sample_id < b.sample_id LEFT JOIN counted c ON c.sample_a = a.sample_id AND c.sample_b = b.sample_id
   LEFT JOIN common m ON m.sample_a = a.sample_id AND m.sample_b = b.sample_id LEFT JOIN clean k ON k.sample_a = a.sample_id AND k.sample_b = b.sample_id)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pairwise_distances(_joint(spark, sf_dir), regions(spark, sf_dir), mask(spark, sf_dir), view(spark, sf_dir, "sites"))


@query("pairwise_distances", with_sql(" SELECT * FROM pairs", _PAIRS))
def pairwise_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query("callable_summary", with_sql(" SELECT sample_id, COUNT(*) AS bases, ROUND(COUNT(*) * 1.0 / MAX(COUNT(*)) OVER (), 6) AS share FROM deep GROUP BY sample_id", _REGIONS))
def callable_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.callable_summary(regions(spark, sf_dir)).withColumn("share", F.round("share", 6))


#: Pairs of the clustering queries: customers of a nation, linked if their balances are close.
_CLUSTER_PAIRS = """
 cust AS (SELECT CONCAT('N', CAST(c_custkey AS VARCHAR(9))) AS sample_id, c_nationkey AS g, CAST(FLOOR(c_acctbal / 100) AS BIGINT) AS b FROM customer),
 ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY b, sample_id) AS i FROM cust),
 cpairs AS (SELECT x.sample_id AS sample_a, y.sample_id AS sample_b, y.b - x.b AS snps, CASE WHEN (x.b + y.b) % 7 = 0 THEN 100 ELSE 4000000 END AS shared_callable_sites
   FROM ranked x JOIN ranked y ON x.g = y.g AND y.i > x.i AND y.i <= x.i + 3)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples and pairs of ``_CLUSTER_PAIRS``; each sample meets the three after it by their places, not all of its nation."""
    cust = run_sql(spark, sf_dir, f"WITH {_CLUSTER_PAIRS} SELECT * FROM cust")
    return cust.select("sample_id"), _neighbours(cust)


def _neighbours(cust: DataFrame, reach: int = 3) -> DataFrame:
    """(sample_a, sample_b, snps, shared_callable_sites): each of ``cust`` (sample_id, g, b) with the ``reach`` after it in its group, by b and name.

    Places are counted within each b, after all of smaller ones, so no task has a whole group; places and their offsets
    are keys of the join.
    """
    each = cust.filter("g is not null")
    sizes = each.groupBy("g", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy(F.asc_nulls_last("b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select(F.col("g").alias("g0"), F.col("b").alias("b0"), before.alias("before"))
    placed = each.withColumn("i", F.row_number().over(W.partitionBy("g", "b").orderBy("sample_id")))
    placed = placed.join(start, (F.col("g") == F.col("g0")) & F.col("b").eqNullSafe(F.col("b0"))).select("sample_id", "g", "b", (F.col("before") + F.col("i")).alias("i"))
    x = placed.select(F.col("sample_id").alias("sample_a"), "g", F.col("b").alias("x"), F.explode(F.array(*[F.col("i") + d for d in range(1, reach + 1)])).alias("i"))
    y = placed.select(F.col("sample_id").alias("sample_b"), "g", F.col("b").alias("y"), "i")
    thin = (F.col("x") + F.col("y")) % 7 == 0
    return x.join(y, ["g", "i"]).select("sample_a", "sample_b", (F.col("y") - F.col("x")).alias("snps"), F.when(thin, 100).otherwise(4000000).alias("shared_callable_sites"))


_CLUSTERS = """
 links AS (SELECT sample_a AS a, sample_b AS b FROM cpairs WHERE snps <= {t} AND shared_callable_sites >= 3000000 UNION SELECT sample_b, sample_a FROM cpairs WHERE snps <= {t} AND shared_callable_sites >= 3000000),
 reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
 comp AS (SELECT node, MIN(seen) AS root FROM reach GROUP BY node),
 sized AS (SELECT root, COUNT(*) AS size, MIN(CONCAT('n~', LPAD(CAST(LENGTH(node) - 1 AS VARCHAR), 9, '0'), SUBSTR(node, 2))) AS first FROM comp GROUP BY root),
 ids AS (SELECT root, CONCAT('C', CAST(ROW_NUMBER() OVER (ORDER BY size DESC, first) AS VARCHAR)) AS cluster_id FROM sized)"""


@query(
    "cluster_members",
    f"WITH RECURSIVE {_CLUSTER_PAIRS},{_CLUSTERS.format(t=1)} SELECT c.sample_id, i.cluster_id FROM cust c LEFT JOIN comp k ON k.node = c.sample_id LEFT JOIN ids i USING (root)",
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, found = _chain(spark, sf_dir)
    return H.cluster_members(samples, found, 1)


#: Edges in one order; an edge is in the forest if lighter ones do not connect its ends.
_FOREST = """
 line AS (SELECT sample_a AS a, sample_b AS b, snps AS w, ROW_NUMBER() OVER (ORDER BY snps, LEAST(sample_a, sample_b), GREATEST(sample_a, sample_b)) AS r FROM cpairs WHERE shared_callable_sites >= 3000000 AND snps <= {t}),
 way AS (SELECT a, b, r FROM line UNION ALL SELECT b, a, r FROM line),
 met AS (SELECT a AS start, b AS goal, r AS edge, a AS seen FROM line UNION SELECT m.start, m.goal, m.edge, y.b FROM met m JOIN way y ON y.a = m.seen AND y.r < m.edge),
 forest AS (SELECT l.* FROM line l WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.edge = l.r AND m.seen = l.b))"""


@query("spanning_forest", f"WITH RECURSIVE {_CLUSTER_PAIRS},{_FOREST.format(t=3)} SELECT LEAST(a, b) AS sample_a, GREATEST(a, b) AS sample_b, w AS snps FROM forest")
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-linkage tree of the cohort: its lightest edges that join all that can be joined."""
    _, found = _chain(spark, sf_dir)
    return H.minimum_spanning_forest(H.comparable_pairs(found).filter("state = 'comparable' and snps <= 3"))


def _at(t: int) -> str:
    """Clusters at a threshold, each view by a name of its own."""
    text = _CLUSTERS.format(t=t)
    for name in ("links", "reach", "comp", "sized", "ids"):
        text = text.replace(f" {name} AS", f" {name}{t} AS").replace(f"FROM {name}", f"FROM {name}{t}").replace(f"JOIN {name} ", f"JOIN {name}{t} ")
    return text


_THRESHOLDS = (0, 1, 2, 5)


@query(
    "clusters_at",
    f"WITH RECURSIVE {_CLUSTER_PAIRS},{','.join(map(_at, _THRESHOLDS))} "
    + " UNION ALL ".join(f"SELECT {t} AS threshold, c.sample_id, i.cluster_id FROM cust c LEFT JOIN comp{t} k ON k.node = c.sample_id LEFT JOIN ids{t} i USING (root)" for t in _THRESHOLDS),
)
def clusters_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, found = _chain(spark, sf_dir)
    return H.clusters_at(samples, found, list(_THRESHOLDS))


@query(
    "cluster_summary",
    f"""WITH RECURSIVE {_CLUSTER_PAIRS},{_CLUSTERS.format(t=1)},
 inside AS (SELECT k.node, i.cluster_id FROM comp k JOIN ids i USING (root)),
 own AS (SELECT a.cluster_id, p.* FROM cpairs p JOIN inside a ON a.node = p.sample_a JOIN inside b ON b.node = p.sample_b AND b.cluster_id = a.cluster_id WHERE shared_callable_sites >= 3000000)
 SELECT s.cluster_id, s.size, o.max_distance, CAST(o.compared AS BIGINT) AS compared, o.max_distance > 1 AS chained FROM (SELECT cluster_id, COUNT(*) AS size FROM inside GROUP BY cluster_id) s
 LEFT JOIN (SELECT cluster_id, MAX(snps) AS max_distance, COUNT(*) AS compared FROM own GROUP BY cluster_id) o USING (cluster_id)""",
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, found = _chain(spark, sf_dir)
    found = materialise(found, "pairs")
    return H.cluster_summary(H.cluster_members(samples, found, 1), found, 1).select("cluster_id", "size", "max_distance", "compared", "chained")


@query("upgma_tree")
def upgma_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.upgma(pairs(spark, sf_dir).select("sample_a", "sample_b", "snps"))
