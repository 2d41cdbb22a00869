"""Views of sequencing data derived from the given tables, as SQL that Spark and DuckDB read alike.

The given tables hold no sequencing data; these views stand for it. ``CTES`` begins every oracle's SQL, and
:func:`view` gives one of them as a DataFrame.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from isolates.session import read_table

#: Samples of the cohort. Positions are the parts, so sites, variants, regions, catalogue and barcode grow with the tables;
#: the number of samples stays, as the pairs of a cohort grow with its square.
SAMPLES = 100


def ctes() -> str:
    """The views in order, ready to stand after WITH."""
    return f"""
reads AS (
  SELECT l_suppkey % {SAMPLES} AS s, CASE WHEN l_linestatus = 'O' THEN 'c1' ELSE 'c2' END AS chrom,
         CAST(l_partkey AS INT) + 1 AS pos,
         CASE WHEN l_linenumber % 7 = 0 THEN 'T' WHEN l_linenumber % 7 = 3 THEN 'G' WHEN l_linenumber % 7 = 5 THEN 'C' ELSE 'A' END AS base,
         CAST(l_quantity AS INT) AS n
  FROM lineitem),
sites AS (
  SELECT CONCAT('S', CAST(s AS VARCHAR(9))) AS sample_id, chrom, pos,
         CAST(SUM(CASE WHEN base = 'A' THEN n ELSE 0 END) AS BIGINT) AS n_a, CAST(SUM(CASE WHEN base = 'C' THEN n ELSE 0 END) AS BIGINT) AS n_c,
         CAST(SUM(CASE WHEN base = 'G' THEN n ELSE 0 END) AS BIGINT) AS n_g, CAST(SUM(CASE WHEN base = 'T' THEN n ELSE 0 END) AS BIGINT) AS n_t
  FROM reads GROUP BY s, chrom, pos),
depths AS (SELECT sample_id, chrom, pos, n_a + n_c + n_g + n_t AS depth, pos % 41 AS qual FROM sites),
barcode AS (
  SELECT CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, CAST(p_partkey AS INT) + 1 AS pos,
         CASE WHEN p_partkey % 3 = 0 THEN CONCAT('lineage', CAST(p_partkey % 4 + 1 AS VARCHAR(9)))
              ELSE CONCAT('lineage', CAST(p_partkey % 4 + 1 AS VARCHAR(9)), '.', CAST(p_partkey % 2 + 1 AS VARCHAR(9))) END AS taxon,
         CASE WHEN p_partkey % 10 = 9 THEN 'C' ELSE 'A' END AS allele
  FROM part),
catalogue AS (
  SELECT CAST(p_partkey AS BIGINT) AS entry_id, CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, CAST(p_partkey AS INT) + 1 AS pos, 'A' AS ref,
         CASE WHEN p_size % 3 = 0 THEN 'C' WHEN p_size % 3 = 1 THEN 'G' ELSE 'T' END AS alt,
         p_brand AS gene, LOWER(p_type) AS drug,
         CASE p_partkey % 3 WHEN 0 THEN 'WHO' WHEN 1 THEN 'flat' ELSE 'third' END AS catalogue,
         CAST(p_size % 5 + 1 AS INT) AS grade,
         CASE p_size % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'R-interim' WHEN 2 THEN 'Uncertain' WHEN 3 THEN 'S-interim' ELSE 'S' END AS call
  FROM part),
contigs AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, CAST(MAX(p_partkey) + 60 AS BIGINT) AS length FROM part GROUP BY 1),
genes AS (
  SELECT CASE WHEN block = 0 THEN p_brand ELSE CONCAT(p_brand, '.', CAST(block AS VARCHAR(9))) END AS name,
         chrom, MIN(p) AS start_pos, MIN(p) + 59 AS end_pos, CASE WHEN MIN(p) % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, CAST(p_partkey AS INT) + 1 AS p, CAST(FLOOR(p_partkey / 500) AS INT) AS block FROM part) g
  GROUP BY p_brand, chrom, block),
mask_raw AS (SELECT 'mask' AS set_id, chrom, CAST(p AS INT) AS start_pos, CAST(p + 5 AS INT) AS end_pos FROM (
  SELECT CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, p_partkey AS p FROM part WHERE p_size % 7 = 0) m),
variants AS (
  SELECT sample_id, CONCAT(chrom, ':', CAST(pos AS VARCHAR(9)), 'A>', alt) AS variant_id, chrom, pos, 'A' AS ref, alt, alt_reads, depth, allele_reads, pos % 11 AS flag
  FROM (SELECT sample_id, chrom, pos, n_a + n_c + n_g + n_t AS depth, GREATEST(n_c, n_g, n_t) AS alt_reads, GREATEST(n_c, n_g, n_t) AS allele_reads,
               CASE WHEN n_c >= n_g AND n_c >= n_t THEN 'C' WHEN n_g >= n_t THEN 'G' ELSE 'T' END AS alt
        FROM sites) v WHERE alt_reads > 0)
"""


def with_sql(body: str, more: str = "") -> str:
    """SQL for DuckDB: the views, then ``more`` views, then ``body``."""
    return "WITH" + ctes() + ("," + more if more else "") + body


@cache
def _names() -> tuple[str, ...]:
    return ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the given tables; a table's name stands after FROM or JOIN."""
    used, text = {}, sql.replace("{", "{{").replace("}", "}}")
    for name in _names():
        for word in ("FROM", "JOIN"):
            if f"{word} {name}" in text:
                text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
                used[name] = read_table(spark, sf_dir, name)
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views."""
    return run_sql(spark, sf_dir, "WITH" + ctes() + f" SELECT * FROM {name}")
