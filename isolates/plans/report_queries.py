"""Registered queries on report rows, checks and references, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.operators import checks as Q
from isolates.operators import cohort as H
from isolates.operators import contamination as X
from isolates.operators import coverage as C
from isolates.operators import lineage as L
from isolates.operators import report as P
from isolates.operators import resistance as R
from isolates.operators import species as Z
from isolates.plans import typing_queries
from isolates.plans.cohort_queries import _CLUSTER_PAIRS, _CLUSTERS, _CONSENSUS, _PAIRS, _chain, _joint, contributions, variants
from isolates.plans.detail_queries import _ASSIGNED
from isolates.plans.fixtures import run_sql, view, with_sql
from isolates.plans.typing_queries import _support, mask, regions
from isolates.session import materialise
from isolates.sources import views as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Drugs of the view's catalogue.
DRUGS = ("economy", "large", "medium", "promo", "small", "standard")


@query("cohort_drug_grid", with_sql(" SELECT sample_id, " + ", ".join(f"MAX(CASE WHEN drug = '{d}' THEN call END) AS {d}" for d in DRUGS) + " FROM graded GROUP BY sample_id", _CONSENSUS))
def cohort_drug_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drug_grid(R.consensus(contributions(spark, sf_dir), "illumina"), list(DRUGS))


@query("graded_rows", with_sql(" SELECT sample_id, variant_id, chrom, pos, depth, ROUND(af, 4) AS allele_fraction, catalogue, drug, CAST(grade AS VARCHAR) AS grade, call, 'coordinate' AS matched_by FROM parts", _CONSENSUS))
def graded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.graded_rows(variants(spark, sf_dir), contributions(spark, sf_dir))


_WORST = "CASE MAX({0}) WHEN 6 THEN 'R' WHEN 5 THEN 'R-outside-WHO' WHEN 4 THEN 'R-interim' WHEN 3 THEN 'Uncertain' WHEN 1 THEN 'S-interim' WHEN 0 THEN 'S' ELSE 'no-call' END"


@query(
    "plot_points",
    with_sql(
        f"""
 SELECT v.sample_id, v.variant_id, ROUND(v.af, 6) AS allele_fraction, COALESCE(d.call, k.call, 'no-call') AS call, COALESCE(k.call, 'no-call') AS catalogue_call, k.call IS NOT NULL AS catalogued, COALESCE(k.drugs, '') AS drugs
 FROM v LEFT JOIN (SELECT sample_id, variant_id, {_WORST.format('sev')} AS call, STRING_AGG(DISTINCT drug, ',' ORDER BY drug) AS drugs FROM parts GROUP BY sample_id, variant_id) k USING (sample_id, variant_id)
 LEFT JOIN (SELECT sample_id, variant_id, {_WORST.format('sev')} AS call FROM (
   SELECT sample_id, UNNEST(STRING_SPLIT(supporting_variants, ',')) AS variant_id, CASE call WHEN 'R' THEN 6 WHEN 'R-outside-WHO' THEN 5 WHEN 'R-interim' THEN 4 WHEN 'Uncertain' THEN 3 WHEN 'S-interim' THEN 1 WHEN 'S' THEN 0 END AS sev
   FROM graded WHERE supporting_variants IS NOT NULL) u GROUP BY sample_id, variant_id) d USING (sample_id, variant_id)""",
        _CONSENSUS,
    ),
)
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = contributions(spark, sf_dir)
    out = P.plot_points(variants(spark, sf_dir), parts, R.consensus(parts, "illumina"))
    return out.select("sample_id", "variant_id", F.round("allele_fraction", 6).alias("allele_fraction"), "call", "catalogue_call", "catalogued", F.array_join("drugs", ",").alias("drugs"))


@query(
    "determinant_lists",
    with_sql(
        """
 SELECT sample_id, drug, CONCAT(ARRAY_TO_STRING(names[1:4], ', '), CASE WHEN LEN(names) > 4 THEN CONCAT(' +', CAST(LEN(names) - 4 AS VARCHAR), ' more') ELSE '' END) AS shown
 FROM (SELECT sample_id, drug, STRING_SPLIT(supporting_variants, ',') AS names FROM graded WHERE supporting_variants IS NOT NULL) g""",
        _CONSENSUS,
    ),
)
def determinant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = R.consensus(contributions(spark, sf_dir), "illumina").filter(F.size("supporting_variants") > 0)
    return calls.select("sample_id", "drug", P.determinants(F.col("supporting_variants")).alias("shown"))


@query(
    "drug_places",
    with_sql(
        """ SELECT sample_id, drug, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY CASE drug WHEN 'standard' THEN 1 WHEN 'economy' THEN 2 ELSE 3 END, drug) AS place FROM graded""",
        _CONSENSUS,
    ),
)
def drug_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([("standard", 1), ("economy", 2)], "drug string, ordinal int")
    return P.in_display_order(R.consensus(contributions(spark, sf_dir), "illumina"), order).select("sample_id", "drug", "place")


@query(
    "lineage_checks",
    f"""WITH called AS ({typing_queries.SQL['lineage_calls']}),
 x AS (SELECT sample_id, sites_callable * 1.0 / NULLIF(sites_total, 0) AS c, sites_supporting * 1.0 / NULLIF(sites_callable, 0) AS s, mixed FROM called)
 SELECT sample_id, 'lineage_callable_fraction' AS name, ROUND(c, 6) AS value, CASE WHEN c >= 0.8 THEN 'pass' ELSE 'warn' END AS status, c IS NOT NULL AS measured FROM x
 UNION ALL SELECT sample_id, 'lineage_support_fraction', ROUND(s, 6), CASE WHEN s >= 0.9 THEN 'pass' ELSE 'warn' END, s IS NOT NULL FROM x
 UNION ALL SELECT sample_id, 'lineage_single_taxon', CASE WHEN mixed = '' THEN 1.0 ELSE 0.0 END, CASE WHEN mixed = '' THEN 'pass' ELSE 'warn' END, TRUE FROM x""",
)
def lineage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lineage_checks(L.call_lineages(_support(spark, sf_dir))).select("sample_id", "name", F.round("value", 6).alias("value"), "status", "measured")


@query(
    "cohort_checks",
    f"""WITH RECURSIVE {_CLUSTER_PAIRS},{_CLUSTERS.format(t=6)},
 far AS (SELECT a.root, MAX(p.snps) AS m FROM cpairs p JOIN comp a ON a.node = p.sample_a JOIN comp b ON b.node = p.sample_b AND b.root = a.root WHERE shared_callable_sites >= 3000000 GROUP BY a.root),
 x AS (SELECT (SELECT COUNT(*) FROM cust) AS n, (SELECT COUNT(*) FROM cpairs) AS p, (SELECT COUNT(*) FROM cpairs WHERE shared_callable_sites >= 3000000) AS fit, (SELECT MIN(shared_callable_sites) FROM cpairs) AS least, (SELECT COUNT(*) FROM far WHERE m > 6) AS chained)
 SELECT r.name, CAST(r.value AS DOUBLE) AS value, r.status FROM (
 SELECT 'cohort_size' AS name, n AS value, CASE WHEN n >= 2 THEN 'pass' ELSE 'warn' END AS status FROM x UNION ALL SELECT 'mask_applied', 1, 'pass' UNION ALL SELECT 'snp_proximity_window', 12, 'pass'
 UNION ALL SELECT 'min_shared_callable_sites', least, CASE WHEN least >= 3000000 THEN 'pass' ELSE 'warn' END FROM x UNION ALL SELECT 'pairs_computed', p, 'pass' FROM x UNION ALL SELECT 'cluster_threshold', 6, 'pass'
 UNION ALL SELECT 'pairs_used_for_clustering', fit, CASE WHEN fit = p THEN 'pass' ELSE 'warn' END FROM x UNION ALL SELECT 'single_linkage_chaining', chained, CASE WHEN chained = 0 THEN 'pass' ELSE 'warn' END FROM x) r""",
)
def cohort_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, pairs = _chain(spark, sf_dir)
    pairs = materialise(pairs, "pairs")
    clusters = H.cluster_summary(H.cluster_members(samples, pairs, 6), pairs, 6)
    return Q.cohort_checks(samples, pairs, clusters, 6).select("name", "value", "status")


@query(
    "foreign_screen",
    f"""WITH {_ASSIGNED}, most AS (SELECT sample_id, MAX(CASE WHEN TRIM(rank) = 'S' AND percentage / 100 > 0.005 AND TRIM(name) NOT LIKE 'taxon3%' THEN percentage / 100 END) AS m FROM assigned GROUP BY sample_id)
 SELECT sample_id, ROUND(COALESCE(m, 0), 6) AS largest_foreign, CASE WHEN m > 0.1 THEN 'fail' ELSE 'pass' END AS status FROM most""",
)
def foreign_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen with a declared index that holds the target's relatives."""
    informative = X.screen_informative("standard", 0.1, ("standard",))
    return X.screen(run_sql(spark, sf_dir, f"WITH {_ASSIGNED} SELECT * FROM assigned"), "taxon3", informative).withColumn("largest_foreign", F.round("largest_foreign", 6))


_PROFILES = """
 profiles AS (SELECT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, SUM(CASE WHEN l_quantity >= 47 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS long_share,
   CAST(MIN(l_quantity) * 200 AS INT) AS median_length, CAST(MAX(l_quantity) * CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE 20 END AS INT) AS max_length FROM lineitem GROUP BY l_suppkey)"""


@query(
    "platforms",
    f"""WITH {_PROFILES}, p AS (SELECT *, long_share >= 0.10 OR median_length >= 1000 AS long, max_length <= 400 AS short, CASE WHEN CAST(SUBSTR(sample_id, 2) AS INT) % 2 = 0 THEN 'ont' END AS hint FROM profiles),
 q AS (SELECT *, CASE WHEN long THEN 'ont' WHEN short THEN 'illumina' WHEN median_length > 400 THEN 'ont' ELSE 'illumina' END AS platform, CASE WHEN long OR short THEN 2 ELSE 0 END AS sure FROM p)
 SELECT sample_id, platform, CASE WHEN sure = 0 THEN 'low' WHEN hint <> platform THEN 'moderate' ELSE 'high' END AS confidence FROM q""",
)
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second sample has a file name that says ``ont``."""
    profiles = run_sql(spark, sf_dir, f"WITH {_PROFILES} SELECT * FROM profiles")
    hints = profiles.filter(F.substring("sample_id", 2, 9).cast("int") % 2 == 0).select("sample_id", F.lit("ont").alias("hint"))
    return C.infer_platform(profiles, hints).select("sample_id", "platform", "confidence")


_CHOICE = """
 asks AS (SELECT CONCAT('S', CAST(s_suppkey AS VARCHAR(9))) AS sample_id, CASE WHEN s_suppkey % 7 = 0 THEN 'own' WHEN s_suppkey % 7 = 1 THEN '' END AS reference, CONCAT('sp', CAST(s_nationkey AS VARCHAR(9))) AS name, CASE s_nationkey % 4 WHEN 0 THEN 'MTBC' ELSE 'NTM' END AS complex FROM supplier),
 genomes AS (SELECT CONCAT('sp', CAST(n_nationkey AS VARCHAR(9))) AS name, CONCAT('ref', n_name) AS reference FROM nation WHERE n_regionkey < 3),
 near AS (SELECT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, CONCAT('near', CAST(MIN(l_partkey) AS VARCHAR(9))) AS reference, CAST(l_quantity + 50 AS DOUBLE) AS ani FROM lineitem GROUP BY l_suppkey, l_quantity)"""


@query(
    "chosen_references",
    f"""WITH {_CHOICE}, best AS (SELECT sample_id, ARG_MAX(reference, ani) AS nearest FROM near WHERE ani >= 80 GROUP BY sample_id)
 SELECT a.sample_id, COALESCE(NULLIF(a.reference, ''), CASE WHEN complex = 'MTBC' THEN 'H37Rv' END, g.reference, b.nearest) AS reference FROM asks a LEFT JOIN genomes g USING (name) LEFT JOIN best b USING (sample_id)""",
)
def chosen_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, genomes, near = (run_sql(spark, sf_dir, f"WITH {_CHOICE} SELECT * FROM {t}") for t in ("asks", "genomes", "near"))
    return Z.choose_reference(asks, asks.select("sample_id", "name", "complex"), genomes, near)


#: Differences and shared callable sites that make a link in the view, whose contigs are as long as there are parts.
LINK, FLOOR = 2, 10


@query(
    "cohort_pairs",
    "WITH RECURSIVE" + with_sql("", _PAIRS).removeprefix("WITH")
    + f""",
 links AS (SELECT sample_a AS a, sample_b AS b FROM pairs WHERE snps <= {LINK} AND shared_callable_sites >= {FLOOR} UNION SELECT sample_b, sample_a FROM pairs WHERE snps <= {LINK} AND shared_callable_sites >= {FLOOR}),
 reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
 comp AS (SELECT node, MIN(seen) AS root FROM reach GROUP BY node)
 SELECT p.sample_a, p.sample_b, p.snps, CASE WHEN shared_callable_sites < {FLOOR} THEN 'thin' ELSE 'comparable' END AS state, p.snps <= {LINK} AS within, shared_callable_sites >= {FLOOR} AS sufficient, COALESCE(a.root = b.root, FALSE) AS same_cluster
 FROM pairs p LEFT JOIN comp a ON a.node = p.sample_a LEFT JOIN comp b ON b.node = p.sample_b""",
)
def cohort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an assembled cohort the pairs, with their state and whether they share a cluster."""
    made = H.assemble(_joint(spark, sf_dir), regions(spark, sf_dir), mask(spark, sf_dir), view(spark, sf_dir, "sites"), LINK, FLOOR)
    return made["pairs"].select("sample_a", "sample_b", "snps", "state", "within", "sufficient", "same_cluster")


# --- the views of a run ---

_LINES = (
    _CONSENSUS
    + """,
 said AS (SELECT sample_id, drug, call, CASE LEAST(conf + CASE WHEN disagreement THEN 1 ELSE 0 END, 3) WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
   disagreement, CASE WHEN disagreement THEN 'biological' ELSE 'none' END AS kind, supporting_variants FROM graded),
 cells AS (
   SELECT 'drugs' AS view, sample_id, CONCAT_WS(chr(9), sample_id, drug, call, confidence, CASE WHEN disagreement THEN 'yes' ELSE 'no' END, COALESCE(REPLACE(supporting_variants, ',', ';'), '')) AS line FROM said
   UNION ALL SELECT 'disagreements', sample_id, CONCAT_WS(chr(9), sample_id, drug, call, kind) FROM said WHERE disagreement
   UNION ALL SELECT 'variants', sample_id, CONCAT_WS(chr(9), sample_id, variant_id, pos, depth, CASE WHEN major THEN 'yes' ELSE 'no' END, REPLACE(filters, ',', ';')) FROM v
   UNION ALL SELECT 'tools', sample_id, CONCAT_WS(chr(9), sample_id, 'caller', '1.2', 'NA') FROM (SELECT DISTINCT sample_id FROM sites) s),
 heads AS (SELECT sample_id, UNNEST(['drugs', 'disagreements', 'variants', 'tools', 'summary', 'catalogue_calls', 'variant_catalogue', 'checks', 'observations', 'lineage_support', 'databases']) AS view FROM (SELECT DISTINCT sample_id FROM sites) s)"""
)


@query(
    "run_views",
    with_sql(
        """
 SELECT h.view, h.sample_id, COUNT(c.line) AS rows, md5(COALESCE(STRING_AGG(c.line, chr(10) ORDER BY c.line), '')) AS digest FROM heads h LEFT JOIN cells c USING (view, sample_id) GROUP BY h.view, h.sample_id""",
        _LINES,
    ),
)
def run_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views of all samples as the lines that one write puts into their files: how many each has, and their digest."""
    called = variants(spark, sf_dir)
    calls = R.consensus(contributions(spark, sf_dir), "illumina")
    tools = spark.range(1).select(F.lit("caller").alias("tool"), F.lit("1.2").alias("version"), F.lit(None).cast("double").alias("seconds"))
    views = {
        "drugs": calls.select("sample_id", "drug", "call", "confidence", "disagreement", "supporting_variants"),
        "disagreements": calls.filter("disagreement").select("sample_id", "drug", "call", "disagreement_kind"),
        "variants": called.select("sample_id", "variant_id", "pos", "depth", "is_major", "filters"),
        "tools": tools,
    }
    table = V.all_lines(views, view(spark, sf_dir, "sites"))
    body = F.when(F.col("ordinal") != "0", F.col("line"))
    held = table.groupBy("view", "sample_id").agg(F.count(body).alias("rows"), F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("text"))
    return held.select("view", "sample_id", "rows", F.md5("text").alias("digest"))
