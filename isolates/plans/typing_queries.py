"""Registered queries on sites, coverage, intervals and lineages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.operators import contamination as C
from isolates.operators import coverage as V
from isolates.operators import intervals as I
from isolates.operators import lineage as L
from isolates.operators import sites as S
from isolates.plans.fixtures import view, with_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with SQL if it can be expressed."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The genotype of a site: depth, major allele (NULL at a tie) and its reads.
_GENOTYPES = """
 top AS (SELECT *, n_a + n_c + n_g + n_t AS depth, GREATEST(n_a, n_c, n_g, n_t) AS best FROM sites),
 geno AS (
  SELECT *, CASE WHEN best = 0 THEN NULL
    WHEN (CASE WHEN n_a = best THEN 1 ELSE 0 END + CASE WHEN n_c = best THEN 1 ELSE 0 END + CASE WHEN n_g = best THEN 1 ELSE 0 END + CASE WHEN n_t = best THEN 1 ELSE 0 END) > 1 THEN NULL
    WHEN n_t = best THEN 'T' WHEN n_g = best THEN 'G' WHEN n_c = best THEN 'C' ELSE 'A' END AS allele
  FROM top)"""


@query(
    "site_genotypes",
    with_sql(
        """
 SELECT sample_id, chrom, pos, depth, allele, ROUND(best * 1.0 / depth, 6) AS fraction,
        CASE WHEN allele IS NULL THEN 'tie' WHEN best < 3 THEN 'few reads' WHEN best * 1.0 / depth < 0.9 THEN 'low fraction' ELSE '' END AS reason
 FROM (SELECT sample_id, chrom, pos, depth, allele, CASE WHEN allele IS NULL THEN NULL ELSE best END AS best FROM geno) g""",
        _GENOTYPES,
    ),
)
def site_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.genotype_sites(view(spark, sf_dir, "sites"), "illumina", min_fraction=0.9)
    return out.select("sample_id", "chrom", "pos", "depth", "allele", F.round("fraction", 6).alias("fraction"), "reason")


@query(
    "legacy_major_alleles",
    with_sql(
        """
 SELECT sample_id, chrom, pos, CASE WHEN n_t = best THEN 'T' WHEN n_g = best THEN 'G' WHEN n_c = best THEN 'C' ELSE 'A' END AS allele,
        ROUND(best * 1.0 / depth, 6) AS unambiguous, best * 1.0 / depth >= 0.95 AS clear FROM geno""",
        _GENOTYPES,
    ),
)
def legacy_major_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites").withColumns({"n_n": F.lit(0), "n_gap": F.lit(0)})
    out = S.with_alleles(sites, "legacy")
    return out.select("sample_id", "chrom", "pos", "allele", F.round("fraction", 6).alias("unambiguous"), (F.col("fraction") >= 0.95).alias("clear"))


@query(
    "alleles_present",
    with_sql(
        """
 SELECT sample_id, chrom, pos, base, n, ROUND(n * 1.0 / depth, 6) AS fraction, CAST(rank AS INT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, chrom, pos ORDER BY n DESC, base) AS rank FROM (
   SELECT sample_id, chrom, pos, 'A' AS base, n_a AS n, n_a + n_c + n_g + n_t AS depth FROM sites UNION ALL
   SELECT sample_id, chrom, pos, 'C', n_c, n_a + n_c + n_g + n_t FROM sites UNION ALL
   SELECT sample_id, chrom, pos, 'G', n_g, n_a + n_c + n_g + n_t FROM sites UNION ALL
   SELECT sample_id, chrom, pos, 'T', n_t, n_a + n_c + n_g + n_t FROM sites) b) r WHERE n >= 1 AND n * 1.0 / depth >= 0.05""",
    ),
)
def alleles_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.alleles_present(view(spark, sf_dir, "sites"))
    return out.select("sample_id", "chrom", "pos", "base", "n", F.round("fraction", 6).alias("fraction"), "rank")


@query(
    "wanted_positions",
    with_sql(
        """
 SELECT g.sample_id, g.chrom, g.pos, n_a, s.sample_id IS NOT NULL AS covered
 FROM (SELECT DISTINCT x.sample_id, w.chrom, w.pos FROM (SELECT DISTINCT sample_id FROM sites) x CROSS JOIN
       (SELECT chrom, pos FROM barcode UNION SELECT chrom, pos FROM catalogue) w) g
 LEFT JOIN sites s ON s.sample_id = g.sample_id AND s.chrom = g.chrom AND s.pos = g.pos"""
    ),
)
def wanted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites")
    wanted = S.required_positions(view(spark, sf_dir, "barcode"), view(spark, sf_dir, "catalogue"))
    return S.at_positions(sites, sites, wanted).select("sample_id", "chrom", "pos", "n_a", "covered")


_SUPPORT = (
    _GENOTYPES
    + """,
 bar AS (
  SELECT x.sample_id, b.taxon, COALESCE(g.depth, 0) AS depth, g.allele AS observed,
         CASE b.allele WHEN 'A' THEN COALESCE(n_a, 0) ELSE COALESCE(n_c, 0) END AS target, b.allele AS expected
  FROM (SELECT DISTINCT sample_id FROM sites) x CROSS JOIN (SELECT * FROM barcode WHERE allele = 'A' OR taxon LIKE '%.1') b
  LEFT JOIN geno g ON g.sample_id = x.sample_id AND g.chrom = b.chrom AND g.pos = b.pos),
 called AS (SELECT *, depth >= 3 AND observed IS NOT NULL AS ok FROM bar),
 flags AS (SELECT *, COALESCE(ok AND observed = expected AND target >= 3, FALSE) AS yes FROM called),
 support AS (
  SELECT sample_id, taxon, COUNT(*) AS total, SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS callable_sites, SUM(CASE WHEN yes THEN 1 ELSE 0 END) AS supporting,
         SUM(CASE WHEN ok AND NOT yes AND target * 1.0 / depth >= 0.05 THEN 1 ELSE 0 END) AS minor
  FROM flags GROUP BY sample_id, taxon),
 judged AS (
  SELECT *, COALESCE(callable_sites * 1.0 / total >= 0.8 AND callable_sites > 0 AND supporting * 1.0 / NULLIF(callable_sites, 0) >= 0.9, FALSE) AS supported,
         COALESCE(callable_sites * 1.0 / total >= 0.8 AND minor * 1.0 / NULLIF(callable_sites, 0) >= 0.9, FALSE) AS minor_supported,
         CASE WHEN taxon LIKE '%.%' THEN 2 ELSE 1 END AS level, CASE WHEN taxon LIKE '%.%' THEN SUBSTR(taxon, 1, 8) END AS parent
  FROM support)"""
)


def _support(spark: SparkSession, sf_dir: str, sites: DataFrame | None = None) -> DataFrame:
    # the sites of most taxa are all ancestral here; those that are not stay with a few taxa, so that some are refuted
    barcode = view(spark, sf_dir, "barcode").filter("allele = 'A' or taxon like '%.1'").select("chrom", "pos", "taxon", F.array("allele").alias("alleles"))
    return L.barcode_support(view(spark, sf_dir, "sites") if sites is None else sites, barcode, "illumina")


@query(
    "taxon_support",
    with_sql(
        """
 SELECT sample_id, taxon, total, CAST(callable_sites AS BIGINT) AS callable_sites, CAST(supporting AS BIGINT) AS supporting, CAST(minor AS BIGINT) AS minor,
        ROUND(callable_sites * 1.0 / total, 6) AS callable_fraction, ROUND(supporting * 1.0 / NULLIF(callable_sites, 0), 6) AS support_fraction, supported, minor_supported
 FROM judged""",
        _SUPPORT,
    ),
)
def taxon_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _support(spark, sf_dir)
    return out.select(
        "sample_id", "taxon", "total", "callable_sites", "supporting", "minor", F.round("callable_fraction", 6).alias("callable_fraction"), F.round("support_fraction", 6).alias("support_fraction"), "supported", "minor_supported"
    )


@query(
    "lineage_calls",
    with_sql(
        """
 SELECT s.sample_id, c.taxon, CASE WHEN c.taxon IS NULL THEN NULL ELSE SUBSTR(c.taxon, 1, 8) END AS lineage, CASE WHEN c.taxon LIKE '%.%' THEN c.taxon END AS sublineage,
        CAST(k.sites_total AS BIGINT) AS sites_total, CAST(k.sites_callable AS BIGINT) AS sites_callable, CAST(k.sites_supporting AS BIGINT) AS sites_supporting,
        COALESCE(k.mixed, '') AS mixed,
        CASE WHEN c.taxon IS NULL OR COALESCE(k.sites_callable, 0) = 0 THEN 'none'
             WHEN COALESCE(k.mixed, '') <> '' THEN CASE WHEN k.sites_supporting < k.sites_callable THEN 'low' ELSE 'moderate' END
             WHEN k.sites_callable = k.sites_total AND k.sites_supporting = k.sites_callable THEN 'high'
             WHEN k.sites_callable * 1.0 / k.sites_total >= 0.8 AND k.sites_supporting * 1.0 / k.sites_callable >= 0.9 THEN 'moderate' ELSE 'low' END AS confidence
 FROM (SELECT DISTINCT sample_id FROM sites) s LEFT JOIN chosen c USING (sample_id) LEFT JOIN (
  SELECT t.sample_id, SUM(CASE WHEN chain THEN total END) AS sites_total, SUM(CASE WHEN chain THEN callable_sites END) AS sites_callable, SUM(CASE WHEN chain THEN supporting END) AS sites_supporting,
         CONCAT_WS(',', STRING_AGG(CASE WHEN off THEN taxon END, ',' ORDER BY taxon), STRING_AGG(CASE WHEN minor_supported AND NOT chain AND NOT off THEN taxon END, ',' ORDER BY taxon)) AS mixed
  FROM (SELECT j.*, (j.taxon = h.taxon OR (h.taxon LIKE '%.%' AND j.taxon = SUBSTR(h.taxon, 1, 8))) AND (h.consistent OR j.supported) AS chain,
               j.supported AND NOT ((j.taxon = h.taxon OR (h.taxon LIKE '%.%' AND j.taxon = SUBSTR(h.taxon, 1, 8))) AND (h.consistent OR j.supported))
                 AND (NOT COALESCE(j.parent = h.taxon, FALSE) OR NOT h.consistent) AS off
        FROM judged j JOIN chosen h USING (sample_id)) t GROUP BY t.sample_id) k USING (sample_id)""",
        _SUPPORT
        + """,
 ranked AS (
  SELECT j.sample_id, j.taxon, j.level, j.supporting, p.taxon IS NOT NULL AS refuted
  FROM judged j LEFT JOIN judged p ON p.sample_id = j.sample_id AND p.taxon = j.parent AND NOT p.supported AND p.callable_sites > 0 WHERE j.supported),
 chosen AS (
  SELECT sample_id, taxon, NOT refuted AS consistent FROM (
   SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY refuted, CASE WHEN refuted THEN level ELSE -level END, CASE WHEN refuted THEN 0 ELSE -supporting END, taxon) AS i FROM ranked) r WHERE i = 1)""",
    ),
)
def lineage_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.call_lineages(_support(spark, sf_dir))
    return out.select("sample_id", "taxon", "lineage", "sublineage", "sites_total", "sites_callable", "sites_supporting", F.array_join("mixed", ",").alias("mixed"), "confidence")


@query("depth_histogram", with_sql(" SELECT sample_id, chrom, depth, COUNT(*) AS positions FROM depths GROUP BY sample_id, chrom, depth"))
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.depth_histogram(view(spark, sf_dir, "depths"))


@query(
    "coverage",
    with_sql(
        """
 SELECT sample_id, COUNT(*) AS positions, ROUND(AVG(depth), 6) AS mean_depth, CAST(MEDIAN(depth) AS DOUBLE) AS median_depth,
        ROUND(SUM(CASE WHEN depth >= 60 THEN 1 ELSE 0 END) * 1.0 / COUNT(*), 6) AS breadth,
        ROUND(SUM(CASE WHEN depth >= 0.5 * mean AND depth <= 2.0 * mean AND mean > 0 THEN 1 ELSE 0 END) * 1.0 / COUNT(*), 6) AS evenness
 FROM (SELECT *, AVG(depth) OVER (PARTITION BY sample_id) AS mean FROM (
   SELECT g.sample_id, COALESCE(d.depth, 0) AS depth FROM (
     SELECT s.sample_id, p.chrom, p.pos FROM (SELECT DISTINCT sample_id FROM sites) s, (SELECT chrom, UNNEST(RANGE(1, length + 1)) AS pos FROM contigs) p) g
   LEFT JOIN depths d ON d.sample_id = g.sample_id AND d.chrom = g.chrom AND d.pos = g.pos) x) y GROUP BY sample_id"""
    ),
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    depths = view(spark, sf_dir, "depths")
    whole = view(spark, sf_dir, "contigs").agg(F.sum("length").alias("length"))
    lengths = depths.select("sample_id").distinct().join(whole, how="cross")
    out = V.coverage(V.merge_contigs(V.depth_histogram(depths)), lengths, breadth_at=60)
    return out.select("sample_id", "positions", *[F.round(c, 6).alias(c) for c in ("mean_depth", "median_depth", "breadth", "evenness")])


_REGIONS = """
 deep AS (SELECT sample_id, chrom, pos FROM depths WHERE depth >= 20),
 regions AS (
  SELECT sample_id, chrom, CAST(MIN(pos) - 1 AS INT) AS start_pos, CAST(MAX(pos) AS INT) AS end_pos FROM (
   SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS island FROM deep) i GROUP BY sample_id, chrom, island)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.callable_regions(view(spark, sf_dir, "depths"), 20).select("sample_id", "chrom", F.col("start_pos").cast("int"), F.col("end_pos").cast("int"))


@query("callable_regions", with_sql(" SELECT * FROM regions", _REGIONS))
def callable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)


_MASK = """
 mask_points AS (SELECT DISTINCT chrom, UNNEST(RANGE(start_pos, end_pos)) AS p FROM mask_raw),
 mask AS (SELECT chrom, CAST(MIN(p) AS INT) AS start_pos, CAST(MAX(p) + 1 AS INT) AS end_pos FROM (
   SELECT *, p - ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY p) AS island FROM mask_points) i GROUP BY chrom, island)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_intervals(view(spark, sf_dir, "mask_raw")).select("chrom", "start_pos", "end_pos")


@query("merged_mask", with_sql(" SELECT * FROM mask", _MASK))
def merged_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(spark, sf_dir)


_POINTS = _REGIONS + "," + _MASK


@query(
    "regions_minus_mask",
    with_sql(
        """
 SELECT sample_id, chrom, CAST(MIN(pos) - 1 AS INT) AS start_pos, CAST(MAX(pos) AS INT) AS end_pos FROM (
  SELECT d.*, pos - ROW_NUMBER() OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS island
  FROM deep d WHERE NOT EXISTS (SELECT 1 FROM mask_points m WHERE m.chrom = d.chrom AND m.p = d.pos - 1)) i GROUP BY sample_id, chrom, island""",
        _POINTS,
    ),
)
def regions_minus_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = regions(spark, sf_dir)
    per_sample = kept.select("sample_id", "chrom").distinct().join(mask(spark, sf_dir), "chrom").select("sample_id", "chrom", "start_pos", "end_pos")
    return I.subtract(kept, per_sample, ["sample_id", "chrom"])


@query(
    "regions_in_mask",
    with_sql(
        """
 SELECT r.sample_id, r.chrom, GREATEST(r.start_pos, m.start_pos) AS start_pos, LEAST(r.end_pos, m.end_pos) AS end_pos
 FROM regions r JOIN mask m ON m.chrom = r.chrom AND m.start_pos < r.end_pos AND r.start_pos < m.end_pos""",
        _POINTS,
    ),
)
def regions_in_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = regions(spark, sf_dir)
    per_sample = kept.select("sample_id", "chrom").distinct().join(mask(spark, sf_dir), "chrom").select("sample_id", "chrom", "start_pos", "end_pos")
    return I.intersect(kept, per_sample, ["sample_id", "chrom"])


@query(
    "variants_outside_mask",
    with_sql(
        """
 SELECT sample_id, variant_id FROM variants v WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.chrom = v.chrom AND v.pos - 1 >= m.start_pos AND v.pos - 1 < m.end_pos)""",
        _MASK,
    ),
)
def variants_outside_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inside(view(spark, sf_dir, "variants"), mask(spark, sf_dir), ["chrom"], "left_anti").select("sample_id", "variant_id")


@query("masked_fraction", with_sql(" SELECT CAST(bases AS BIGINT) AS bases, CAST(masked AS BIGINT) AS masked, ROUND(masked * 1.0 / bases, 6) AS fraction FROM (SELECT SUM(end_pos - start_pos) AS masked FROM mask) m CROSS JOIN (SELECT SUM(length) AS bases FROM contigs) c", _MASK))
def masked_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.masked_fraction(mask(spark, sf_dir), view(spark, sf_dir, "contigs")).withColumn("fraction", F.round("fraction", 6))


_HET = (
    _GENOTYPES
    + """,
 second AS (
  SELECT t.*, pos % 41 AS qual, LIST_SORT([n_a, n_c, n_g, n_t], 'DESC')[2] AS next FROM top t),
 okay AS (SELECT *, depth >= 10 AND qual >= 20 AS ok, next * 1.0 / NULLIF(depth, 0) AS minor FROM second)"""
)


def _sites_with_qual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites").withColumn("qual", F.col("pos") % 41)


@query(
    "heterozygosity",
    with_sql(
        """
 SELECT sample_id, ROUND(SUM(CASE WHEN ok AND minor >= 0.05 THEN 1 ELSE 0 END) * 1.0 / NULLIF(SUM(CASE WHEN ok THEN 1 ELSE 0 END), 0), 6) AS het_fraction,
        CAST(SUM(CASE WHEN ok AND minor >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS het_sites, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS sites_examined
 FROM okay GROUP BY sample_id""",
        _HET,
    ),
)
def heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.heterozygosity(_sites_with_qual(spark, sf_dir)).withColumn("het_fraction", F.round("het_fraction", 6))


@query("unambiguous_sites", with_sql(" SELECT sample_id, ROUND(SUM(CASE WHEN best * 1.0 / depth >= 0.95 THEN 1 ELSE 0 END) * 1.0 / COUNT(*), 6) AS unambiguous_fraction FROM top WHERE depth > 0 GROUP BY sample_id", _GENOTYPES))
def unambiguous_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unambiguous_fraction(view(spark, sf_dir, "sites")).withColumn("unambiguous_fraction", F.round("unambiguous_fraction", 6))


_PANEL = (
    _HET
    + """,
 panel AS (SELECT o.*, b.taxon, CASE b.allele WHEN 'A' THEN n_a ELSE n_c END * 1.0 / NULLIF(depth, 0) AS derived FROM okay o JOIN barcode b ON b.chrom = o.chrom AND b.pos = o.pos),
 ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY minor DESC) AS i FROM panel WHERE ok),
 f AS (SELECT sample_id, COUNT(*) AS sites_examined, CASE WHEN COUNT(*) >= 2 THEN AVG(CASE WHEN i <= 2 THEN minor END) END AS f2,
         CASE WHEN COUNT(*) >= 47 THEN AVG(CASE WHEN i <= 47 THEN minor END) END AS f47 FROM ordered GROUP BY sample_id)"""
)


@query("f_statistics", with_sql(" SELECT sample_id, sites_examined, ROUND(f2, 6) AS f2, ROUND(f47, 6) AS f47 FROM f", _PANEL))
def f_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = C.lineage_mixture(_sites_with_qual(spark, sf_dir), view(spark, sf_dir, "barcode"))
    return f.select("sample_id", "sites_examined", F.round("f2", 6).alias("f2"), F.round("f47", 6).alias("f47"))


@query(
    "lineage_mixture",
    with_sql(
        """
 SELECT *, COALESCE(callable_fraction >= 0.8 AND mean_fraction >= 0.05 AND mean_fraction < 0.9, FALSE) AS minority_evidence FROM (
 SELECT s.sample_id, t.taxon, t.sites_total, CAST(COALESCE(p.n, 0) AS BIGINT) AS sites_callable, ROUND(COALESCE(p.n, 0) * 1.0 / t.sites_total, 6) AS callable_fraction, ROUND(p.m, 6) AS mean_fraction
 FROM (SELECT DISTINCT sample_id FROM sites) s CROSS JOIN (SELECT taxon, COUNT(*) AS sites_total FROM barcode GROUP BY taxon) t
 LEFT JOIN (SELECT sample_id, taxon, SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS n, AVG(CASE WHEN ok THEN derived END) AS m FROM panel GROUP BY sample_id, taxon) p
   ON p.sample_id = s.sample_id AND p.taxon = t.taxon) x""",
        _PANEL,
    ),
)
def lineage_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = C.lineage_mixture(_sites_with_qual(spark, sf_dir), view(spark, sf_dir, "barcode"))
    return out.select("sample_id", "taxon", "sites_total", "sites_callable", F.round("callable_fraction", 6).alias("callable_fraction"), F.round("mean_fraction", 6).alias("mean_fraction"), "minority_evidence")


_VALIDITY = (
    _PANEL
    + """,
 h AS (SELECT sample_id, SUM(CASE WHEN ok AND minor >= 0.05 THEN 1 ELSE 0 END) * 1.0 / NULLIF(SUM(CASE WHEN ok THEN 1 ELSE 0 END), 0) AS het FROM okay GROUP BY sample_id),
 u AS (SELECT sample_id, SUM(CASE WHEN best * 1.0 / depth >= 0.95 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS unamb, COUNT(*) / 1000.0 AS breadth FROM top WHERE depth > 0 GROUP BY sample_id),
 mix AS (SELECT u.*, h.het, f.f2, f.f47,
   CASE WHEN het IS NULL AND f2 IS NULL AND f47 IS NULL THEN 'not-assessed' WHEN het >= 0.05 THEN 'mixed' WHEN het >= 0.01 OR f2 >= 0.05 OR f47 >= 0.05 THEN 'possible-mixture' ELSE 'single-strain' END AS mixture
   FROM u LEFT JOIN h USING (sample_id) LEFT JOIN f USING (sample_id))"""
)


@query("mixture_classes", with_sql(" SELECT sample_id, mixture FROM mix", _VALIDITY))
def mixture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("sample_id", "mixture")


def _panel(spark: SparkSession, sf_dir: str, sites: DataFrame | None = None) -> DataFrame:
    sites = _sites_with_qual(spark, sf_dir) if sites is None else sites.withColumn("qual", F.col("pos") % 41)
    f, _ = C.lineage_mixture(sites, view(spark, sf_dir, "barcode"))
    unamb = C.unambiguous_fraction(sites)
    breadth = sites.groupBy("sample_id").agg((F.count_if(E.acgt_depth() > 0) / 1000).alias("breadth"))
    out = unamb.join(C.heterozygosity(sites), "sample_id", "left").join(f, "sample_id", "left").join(breadth, "sample_id", "left")
    out = out.withColumn("mixture", C.mixture_class(F.col("het_fraction"), F.col("f2"), F.col("f47"), "illumina"))
    none = F.lit(None)
    return out.withColumns({"mapped_fraction": none.cast("double"), "evenness": none.cast("double"), "gc_within": none.cast("boolean"), "non_target_fraction": none.cast("double")})


@query(
    "sample_validity",
    with_sql(
        """
 SELECT sample_id, use, CASE MAX(r) WHEN 0 THEN 'valid' WHEN 1 THEN 'not-assessed' WHEN 2 THEN 'suspect' ELSE 'invalid' END AS verdict,
        STRING_AGG(CASE WHEN r = worst THEN dimension END, ',' ORDER BY dimension) AS reasons
 FROM (SELECT *, MAX(r) OVER (PARTITION BY sample_id, use) AS worst FROM (
   SELECT sample_id, 'mixture' AS dimension, use, CASE mixture WHEN 'mixed' THEN 3 WHEN 'possible-mixture' THEN CASE use WHEN 'resistance' THEN 2 ELSE 3 END WHEN 'single-strain' THEN 0 ELSE 1 END AS r FROM mix CROSS JOIN uses
   UNION ALL SELECT sample_id, 'mapped_read_fraction', use, 1 FROM mix CROSS JOIN uses
   UNION ALL SELECT sample_id, 'coverage_breadth', use, CASE use WHEN 'resistance' THEN 2 ELSE 3 END FROM mix CROSS JOIN uses WHERE breadth < 0.95
   UNION ALL SELECT sample_id, 'unambiguous_base_fraction', use, 2 FROM mix CROSS JOIN uses WHERE unamb < 0.95) v) w GROUP BY sample_id, use""",
        _VALIDITY + ", uses AS (SELECT 'resistance' AS use UNION ALL SELECT 'transmission')",
    ),
)
def sample_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_validity(_panel(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))
