"""Registered queries on names, rules, other organisms, reads, contamination and report parts, with the SQL for each.

Each begins with a view of the given tables that stands for the operator's input, read alike by Spark and by the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.functions import drugs as D
from isolates.functions import expressions as E
from isolates.functions import hgvs as H
from isolates.operators import catalogue as K
from isolates.operators import cohort
from isolates.operators import contamination as X
from isolates.operators import coverage as C
from isolates.operators import intervals as I
from isolates.operators import lineage as L
from isolates.operators import ntm
from isolates.operators import report as P
from isolates.operators import resistance as R
from isolates.operators import sites as S
from isolates.plans.cohort_queries import _CLUSTER_PAIRS, _CONSENSUS, _VARIANTS, _chain, contributions, variants
from isolates.plans.fixtures import run_sql, view, with_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _view(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {ctes} SELECT * FROM {name}")


# --- names ---

_SPELLED = """
 spelled AS (SELECT DISTINCT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, 395 + l_partkey % 130 AS n FROM lineitem),
 entries AS (SELECT DISTINCT p_size AS entry_id, 390 + p_size * 3 AS m, p_size % 4 = 0 AS placed FROM part)"""


@query(
    "name_matches",
    f"""WITH {_SPELLED},
 met AS (SELECT sample_id, n, entry_id, CASE WHEN m = n AND placed THEN 0 WHEN m = n THEN 1 ELSE 2 END AS route FROM spelled JOIN entries
   ON m = n OR (n BETWEEN 400 AND 510 AND m = n + 81) OR (m BETWEEN 400 AND 510 AND n = m + 81)),
 direct AS (SELECT DISTINCT sample_id, n FROM met WHERE route < 2)
 SELECT sample_id, CONCAT('v', CAST(n AS VARCHAR)) AS variant_id, entry_id, CASE route WHEN 0 THEN 'coordinate' WHEN 1 THEN 'hgvs' ELSE 'alias' END AS matched_by
 FROM met b WHERE route < 2 OR NOT EXISTS (SELECT 1 FROM direct d WHERE d.sample_id = b.sample_id AND d.n = b.n)""",
)
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries reached by coordinates, by name and by the legacy numbering of rpoB."""
    rows = _view(spark, sf_dir, _SPELLED, "spelled")
    place = lambda n: {"chrom": F.lit("c1"), "pos": (F.col(n) * 3).cast("int"), "ref": F.lit("C"), "alt": F.lit("T")}
    found = rows.withColumns({"variant_id": F.concat(F.lit("v"), F.col("n").cast("string")), **place("n"), "gene": F.lit("rpoB"), "hgvs": F.concat(F.lit("S"), F.col("n").cast("string"), F.lit("L"))})
    entries = _view(spark, sf_dir, _SPELLED, "entries")
    named = entries.select("entry_id", F.lit("rpoB").alias("gene"), F.concat(F.lit("p.Ser"), F.col("m").cast("string"), F.lit("Leu")).alias("hgvs"))
    coords = entries.filter("placed").withColumns(place("m")).select("entry_id", "chrom", "pos", "ref", "alt")
    return K.match(found, named, coords)


_NAMED = """
 raw AS (SELECT DISTINCT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, CASE l_partkey % 6 WHEN 0 THEN 'rpoB' WHEN 1 THEN 'katG' WHEN 2 THEN 'pncA' WHEN 3 THEN 'Rv0678' WHEN 4 THEN 'mmpL5' ELSE 'eis' END AS gene,
   l_linenumber % 4 AS kind, 420 + CAST(l_quantity AS INT) AS n, l_discount >= 0.05 AS major FROM lineitem),
 named AS (SELECT sample_id, CONCAT(gene, '-', CAST(kind AS VARCHAR(9)), '-', CAST(n AS VARCHAR(9)), '-', CASE WHEN major THEN 'M' ELSE 'm' END) AS variant_id, gene, kind, n, major,
   CASE kind WHEN 0 THEN CASE WHEN n = 430 THEN 'p.Leu430Pro' ELSE CONCAT('p.Ser', CAST(n AS VARCHAR(9)), 'Trp') END WHEN 1 THEN CONCAT('p.Ser', CAST(n AS VARCHAR(9)), 'fs')
     WHEN 2 THEN CONCAT('p.Ser', CAST(n AS VARCHAR(9)), 'Ser') ELSE CONCAT('c.-', CAST(n AS VARCHAR(9)), 'C>T') END AS hgvs FROM raw)"""
_GENE_DRUGS = [("rpob", ["rifampicin"]), ("katg", ["isoniazid"]), ("pnca", ["pyrazinamide"]), ("rv0678", ["bedaquiline", "clofazimine"]), ("eis", ["amikacin", "kanamycin"])]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _NAMED, "named").withColumns({"effect": F.lit(""), "allele_fraction": F.when(F.col("major"), 0.95).otherwise(0.4)})


@query(
    "rule_calls",
    f"""WITH {_NAMED},
 gd AS (SELECT * FROM (VALUES ('rpoB', 'rifampicin'), ('katG', 'isoniazid'), ('pncA', 'pyrazinamide'), ('Rv0678', 'bedaquiline'), ('Rv0678', 'clofazimine'), ('eis', 'amikacin'), ('eis', 'kanamycin')) t(gene, drug)),
 hit AS (
  SELECT sample_id, variant_id, n, 'rifampicin' AS drug, CASE WHEN hgvs = 'p.Leu430Pro' THEN 1 ELSE 2 END AS grade, CASE WHEN hgvs = 'p.Leu430Pro' THEN 'rpob-borderline' ELSE 'rpob-rrdr' END AS rule
  FROM named WHERE gene = 'rpoB' AND (hgvs = 'p.Leu430Pro' OR (kind < 2 AND n BETWEEN 426 AND 452))
  UNION ALL SELECT sample_id, variant_id, n, drug, 2, 'loss-of-function' FROM named JOIN gd USING (gene) WHERE kind = 1 AND gene IN ('katG', 'pncA', 'Rv0678')
  UNION ALL SELECT sample_id, variant_id, n, drug, 4, 'silent' FROM named JOIN gd USING (gene) WHERE kind = 2)
 SELECT sample_id, variant_id, drug, grade, CASE grade WHEN 1 THEN 'R' WHEN 2 THEN 'R-interim' ELSE 'S-interim' END AS call, rule FROM hit WHERE NOT (drug = 'rifampicin' AND n % 10 = 0)""",
)
def rule_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by rule; rifampicin is graded already for every tenth codon."""
    found = _named(spark, sf_dir)
    graded = found.filter("gene = 'rpoB' and n % 10 = 0").select("sample_id", "variant_id", F.lit("rifampicin").alias("drug"))
    return R.rule_calls(found, graded, spark.createDataFrame(_GENE_DRUGS, "gene string, drugs array<string>"))


@query(
    "epistasis",
    f"""WITH {_NAMED},
 lost AS (SELECT sample_id, gene, BOOL_AND(major) AS all_major, BOOL_OR(major) AS any_major FROM named WHERE kind = 1 AND gene IN ('mmpL5', 'eis') GROUP BY sample_id, gene),
 met AS (SELECT v.sample_id, v.variant_id, l.gene AS cause, (v.major AND NOT l.all_major) OR (NOT v.major AND l.any_major) AS clash
   FROM named v JOIN lost l ON l.sample_id = v.sample_id AND (l.gene = 'mmpL5' AND v.gene = 'Rv0678' OR l.gene = 'eis' AND v.gene = 'eis' AND v.kind = 3)),
 sure AS (SELECT *, NOT BOOL_OR(clash) OVER (PARTITION BY sample_id, cause) AS confident FROM met),
 d AS (SELECT * FROM (VALUES ('mmpL5', 'bedaquiline'), ('mmpL5', 'clofazimine'), ('eis', 'amikacin'), ('eis', 'kanamycin')) t(cause, drug))
 SELECT sample_id, CASE cause WHEN 'mmpL5' THEN 'epistasis:mmpL5-lof-abrogates-Rv0678' ELSE 'epistasis:eis-lof-abrogates-eis-promoter' END AS rule, drug, variant_id, confident FROM sure JOIN d USING (cause)""",
)
def epistasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.epistasis(_named(spark, sf_dir))


@query(
    "name_parts",
    f"""WITH {_NAMED}
 SELECT DISTINCT gene, hgvs, CONCAT(gene, '_', hgvs) AS key, CASE WHEN kind = 0 AND n <> 430 THEN CONCAT('p.S', n, 'W') WHEN kind = 0 THEN 'p.L430P' WHEN kind = 2 THEN CONCAT('p.S', n, 'S') END AS short,
   CASE WHEN gene = 'rpoB' AND kind < 3 AND n BETWEEN 400 AND 510 THEN CONCAT(CASE WHEN kind = 0 AND n = 430 THEN 'p.Leu' ELSE 'p.Ser' END, n + 81, CASE kind WHEN 0 THEN CASE WHEN n = 430 THEN 'Pro' ELSE 'Trp' END WHEN 1 THEN 'fs' ELSE 'Ser' END) END AS legacy,
   CASE WHEN kind < 3 THEN n END AS codon, kind = 3 AS promoter, kind = 2 AS synonymous, kind = 1 AS lost, gene = 'rpoB' AND kind < 3 AND n BETWEEN 426 AND 452 AS in_region,
   CASE WHEN gene = 'rpoB' AND kind < 3 AND n BETWEEN 400 AND 510 THEN 'nomenclature' ELSE 'biological' END AS against_legacy
 FROM named""",
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names say, and whether a name renumbered by 81 codons is another spelling or another change."""
    g, h = F.col("gene"), F.col("hgvs")
    moved = F.concat(F.regexp_extract(h, r"^(\D+)", 1), (F.regexp_extract(h, r"(\d+)", 1).cast("int") + 81).cast("string"), F.regexp_extract(h, r"\d+(.*)$", 1))
    named = _named(spark, sf_dir).select("gene", "hgvs").distinct()
    return named.select(
        g, h, H.hgvs_key(g, h).alias("key"), H.one_letter(h).alias("short"), H.renumbered(g, h).alias("legacy"), H.codon(h).alias("codon"), H.is_promoter(h).alias("promoter"),
        H.is_synonymous(h).alias("synonymous"), H.is_loss_of_function(h, F.lit("")).alias("lost"), H.in_rrdr(g, h).alias("in_region"), H.difference_kind(g, h, moved).alias("against_legacy"),
    )


_ALLELES = "alleles AS (SELECT p_partkey, CAST(p_partkey + 1 AS INT) AS pos, CONCAT(REPEAT('G', CAST(p_size % 5 AS INT)), 'A', REPEAT('T', CAST(p_size % 3 AS INT))) AS ref, CONCAT(REPEAT('G', CAST(p_size % 5 AS INT)), CASE p_size % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'AC' ELSE 'CC' END, REPEAT('T', CAST(p_size % 3 AS INT))) AS alt, p_size FROM part)"


@query(
    "trimmed_alleles",
    f"""WITH {_ALLELES} SELECT p_partkey, CONCAT('c1:', pos, ref, '>', alt) AS key, ref AS parsed_ref, alt AS parsed_alt, pos AS parsed_pos,
 CASE WHEN p_size % 4 = 0 AND LENGTH(ref) = 1 THEN 'snp' WHEN p_size % 4 = 0 THEN 'mnv' WHEN p_size % 4 = 1 AND p_size % 3 = 0 THEN 'insertion' ELSE 'indel' END AS kind,
 CAST(pos + p_size % 5 AS INT) AS trimmed_pos, 'A' AS trimmed_ref, CASE p_size % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'AC' ELSE 'CC' END AS trimmed_alt FROM alleles""",
)
def trimmed_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles with shared ends taken off, and their coordinate key made and read back."""
    rows = _view(spark, sf_dir, _ALLELES, "alleles").withColumn("chrom", F.lit("c1"))
    cut, back = E.trimmed(F.col("pos"), F.col("ref"), F.col("alt")), E.parse_coordinate(E.coordinate_key())
    return rows.select(
        "p_partkey", E.coordinate_key().alias("key"), back["ref"].alias("parsed_ref"), back["alt"].alias("parsed_alt"), back["pos"].alias("parsed_pos"), E.variant_type(F.col("ref"), F.col("alt")).alias("kind"),
        cut["pos"].cast("int").alias("trimmed_pos"), cut["ref"].alias("trimmed_ref"), cut["alt"].alias("trimmed_alt"),
    )


_LETTERS = "letters AS (SELECT doc_id, UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', '', 'g')) AS seq FROM documents)"


@query(
    "translations",
    f"""WITH {_LETTERS}, cut AS (SELECT doc_id, seq, UNNEST(range(0, LENGTH(seq) // 3)) AS i FROM letters),
 res AS (SELECT doc_id, i, SUBSTR('{E.AMINO_ACIDS}', CAST((INSTR('TCAG', SUBSTR(seq, i * 3 + 1, 1)) - 1) * 16 + (INSTR('TCAG', SUBSTR(seq, i * 3 + 2, 1)) - 1) * 4 + INSTR('TCAG', SUBSTR(seq, i * 3 + 3, 1)) AS INT), 1) AS a FROM cut)
 SELECT l.doc_id, CASE WHEN l.seq IS NOT NULL THEN COALESCE(r.protein, '') END AS protein FROM letters l LEFT JOIN (SELECT doc_id, STRING_AGG(a, '' ORDER BY i) AS protein FROM res GROUP BY doc_id) r USING (doc_id)""",
)
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", E.translate(F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", ""))).alias("protein"))


@query(
    "low_complexity",
    f"""WITH {_LETTERS}, w AS (SELECT doc_id, UNNEST(range(0, LENGTH(seq) - 12 + 1, 6)) AS a, seq FROM letters WHERE LENGTH(seq) >= 12),
 s AS (SELECT doc_id, a, SUBSTR(seq, CAST(a + 1 AS INT), 12) AS x FROM w), c AS (SELECT doc_id, a, LIST_SORT([12 - LENGTH(REPLACE(x, 'A', '')), 12 - LENGTH(REPLACE(x, 'C', '')), 12 - LENGTH(REPLACE(x, 'G', '')), 12 - LENGTH(REPLACE(x, 'T', ''))], 'DESC') AS n FROM s),
 f AS (SELECT doc_id, a, CASE WHEN a <= LAG(a) OVER (PARTITION BY doc_id ORDER BY a) + 12 THEN 0 ELSE 1 END AS new FROM c WHERE n[1] + n[2] >= 0.9 * 12),
 r AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM f)
 SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(MIN(a) AS BIGINT) AS start_pos, CAST(MAX(a) + 12 AS BIGINT) AS end_pos FROM r GROUP BY doc_id, run""",
)
def low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents")
    seqs = docs.select(F.col("doc_id").cast("string").alias("chrom"), F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))
    found = I.low_complexity(seqs.filter("seq is not null"), 12, 6, 0.9)
    return found.select("chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


# --- drugs and comments ---

_COMMENTS = """
 comments AS (SELECT p_partkey, p_size, CASE p_size % 6 WHEN 0 THEN ' RIF ' WHEN 1 THEN 'bdq' WHEN 2 THEN 'Delamanid' WHEN 3 THEN 'DCS' WHEN 4 THEN 'Newdrug' ELSE '' END AS drug,
   CONCAT(CASE p_size % 5 WHEN 0 THEN 'High-level resistance.' WHEN 1 THEN 'Low-level resistance; ADDITIVE effect' WHEN 2 THEN 'low-level  resistance' ELSE 'Graded before' END,
          CASE WHEN p_partkey % 2 = 0 THEN ' with cross-resistance' ELSE ' seen' END, CASE p_partkey % 3 WHEN 0 THEN ' to CFZ' WHEN 1 THEN ' to Amikacin and delamanid' ELSE '' END) AS comment,
   CASE p_size % 4 WHEN 0 THEN '1) Assoc w R' WHEN 1 THEN 'Group 2' WHEN 2 THEN '5' ELSE 'six' END AS grade,
   CASE p_size % 4 WHEN 0 THEN ' Nanopore' WHEN 1 THEN 'PE' WHEN 2 THEN 'contigs' ELSE 'other' END AS platform FROM part)"""


@query(
    "drug_comments",
    f"""WITH {_COMMENTS}, n AS (SELECT *, CASE TRIM(drug) WHEN 'RIF' THEN 'rifampicin' WHEN 'bdq' THEN 'bedaquiline' WHEN 'Delamanid' THEN 'delamanid' WHEN 'DCS' THEN 'cycloserine' WHEN 'Newdrug' THEN 'newdrug' END AS name,
   CASE p_partkey % 3 WHEN 0 THEN ['clofazimine'] WHEN 1 THEN ['amikacin', 'delamanid'] ELSE [] END AS named FROM comments),
 o AS (SELECT *, LIST_FILTER(named, lambda x: x IS DISTINCT FROM name) AS others FROM n)
 SELECT p_partkey, name, CASE name WHEN 'rifampicin' THEN 'RIF' WHEN 'bedaquiline' THEN 'BDQ' WHEN 'delamanid' THEN 'DLM' WHEN 'cycloserine' THEN 'CS' WHEN 'newdrug' THEN 'NEW' END AS code,
   CASE p_size % 5 WHEN 0 THEN 'high-level' WHEN 1 THEN 'additive low-level' WHEN 2 THEN 'low-level' END AS level, ARRAY_TO_STRING(named, ',') AS named,
   CASE WHEN p_partkey % 2 = 1 THEN '' WHEN LEN(others) > 0 THEN ARRAY_TO_STRING(others, ',') WHEN name = 'bedaquiline' THEN 'clofazimine' WHEN name = 'delamanid' THEN 'pretomanid' ELSE '' END AS crossed,
   CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 END AS grade, CASE p_size % 4 WHEN 0 THEN 'ont' WHEN 1 THEN 'illumina' WHEN 2 THEN 'fasta' END AS platform FROM o""",
)
def drug_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug names, codes, grades and platforms as users write them, and what comments state."""
    rows = _view(spark, sf_dir, _COMMENTS, "comments")
    drug, comment = F.col("drug"), F.col("comment")
    return rows.select(
        "p_partkey", D.drug_name(drug).alias("name"), D.drug_code(drug).alias("code"), D.level_stated(comment).alias("level"), F.array_join(D.drugs_named(comment), ",").alias("named"),
        F.array_join(D.cross_resistance(comment, drug), ",").alias("crossed"), D.grade_number(F.col("grade")).alias("grade"), D.platform_name(F.col("platform")).alias("platform"),
    )


@query(
    "drug_flags",
    with_sql(
        """
 SELECT sample_id, drug, CONCAT_WS(';', CASE WHEN disagreement THEN 'disagreement:biological' END, CASE WHEN suppressed_by IS NOT NULL THEN 'suppressed' END) AS flags,
   CASE WHEN supporting_variants IS NULL THEN '' WHEN LEN(STRING_SPLIT(supporting_variants, ',')) <= 2 THEN REPLACE(supporting_variants, ',', ', ')
     ELSE CONCAT(STRING_SPLIT(supporting_variants, ',')[1], ', ', STRING_SPLIT(supporting_variants, ',')[2], ' +', LEN(STRING_SPLIT(supporting_variants, ',')) - 2, ' more') END AS determinants,
   CASE WHEN any_suppressed = 1 THEN 'suppressed-evidence' ELSE '' END AS caveats, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY drug) AS place FROM graded""",
        _CONSENSUS,
    ),
)
def drug_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = P.drug_flags(R.consensus(contributions(spark, sf_dir), "illumina"))
    listed = P.in_display_order(calls, spark.createDataFrame([], "drug string, ordinal int"))
    return listed.select("sample_id", "drug", F.array_join("flags", ";").alias("flags"), P.determinants(F.col("supporting_variants"), 2).alias("determinants"), F.array_join("caveats", ";").alias("caveats"), "place")


@query(
    "long_read_caveats",
    with_sql(
        """
 SELECT p.sample_id, p.drug, CASE WHEN call NOT LIKE 'R%' OR COALESCE(m.minor, FALSE) THEN CASE WHEN any_suppressed = 1 THEN 'ont-minor;suppressed-evidence' ELSE 'ont-minor' END WHEN any_suppressed = 1 THEN 'suppressed-evidence' ELSE '' END AS caveats
 FROM decided p LEFT JOIN (SELECT sample_id, drug, BOOL_OR(NOT major) AS minor FROM parts WHERE pass GROUP BY ALL) m USING (sample_id, drug)""",
        _CONSENSUS,
    ),
)
def long_read_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caveats that the same calls carry if they come from long reads."""
    parts = contributions(spark, sf_dir).drop("is_major").join(variants(spark, sf_dir).select("sample_id", "variant_id", "is_major"), ["sample_id", "variant_id"])
    return R.consensus(parts, "ont").select("sample_id", "drug", F.array_join("caveats", ";").alias("caveats"))


# --- other organisms ---

_NTM = """
 bugs AS (SELECT CONCAT('C', CAST(c_custkey AS VARCHAR(9))) AS sample_id, CASE c_nationkey % 3 WHEN 0 THEN 'M. abscessus' WHEN 1 THEN 'mac' ELSE 'M. other' END AS organism, c_nationkey % 3 AS o, c_custkey % 7 AS k, c_acctbal > 0 AS rich FROM customer),
 changes AS (SELECT sample_id, CASE WHEN k = 1 THEN 'rrl' ELSE 'rrs' END AS gene, CASE k WHEN 1 THEN 'n.2058A>G' WHEN 2 THEN 'n.1408A>G' WHEN 3 THEN 'n.1408A>C' ELSE 'n.1409C>T' END AS hgvs, o, k FROM bugs WHERE k BETWEEN 1 AND 4),
 erm AS (SELECT sample_id, TRUE AS present, CASE WHEN k = 5 THEN 0.5 ELSE 1.0 END AS body_coverage, CASE WHEN k = 6 THEN 'C' WHEN rich THEN 'T' END AS base, o, k, rich FROM bugs)"""


@query(
    "other_organism_calls",
    f"""WITH {_NTM},
 state AS (SELECT sample_id, CASE WHEN k = 5 THEN 'truncated' WHEN k = 6 THEN 'sequevar-susceptible' WHEN rich THEN 'inducible' ELSE 'not-assessed' END AS state FROM erm),
 d AS (SELECT * FROM (VALUES ('azithromycin', 'clarithromycin'), ('amikacin', 'amikacin')) t(drug, filed)),
 hits AS (
  SELECT sample_id, 'clarithromycin' AS filed, 'R' AS call, 'rrl' AS gene FROM changes WHERE k = 1 AND o < 2
  UNION ALL SELECT sample_id, 'amikacin', CASE k WHEN 2 THEN 'R' ELSE 'Uncertain' END, 'rrs' FROM changes WHERE k BETWEEN 2 AND 4 AND o < 2
  UNION ALL SELECT s.sample_id, 'clarithromycin', CASE state WHEN 'inducible' THEN 'R' ELSE 'S' END, 'erm(41)' FROM state s JOIN bugs b USING (sample_id) WHERE o = 0 AND state <> 'not-assessed'),
 top AS (SELECT sample_id, filed, MAX(CASE call WHEN 'R' THEN 3 WHEN 'Uncertain' THEN 2 ELSE 1 END) AS t FROM hits GROUP BY ALL),
 need AS (SELECT * FROM (VALUES (0, 'clarithromycin', 'rrl'), (0, 'clarithromycin', 'erm(41)'), (0, 'amikacin', 'rrs'), (1, 'clarithromycin', 'rrl'), (1, 'amikacin', 'rrs')) t(o, filed, gene)),
 miss AS (SELECT b.sample_id, n.filed, COUNT(*) AS genes, SUM(CASE WHEN EXISTS (SELECT 1 FROM changes c WHERE c.sample_id = b.sample_id AND c.gene = n.gene) OR (n.gene = 'erm(41)' AND s.state <> 'not-assessed') OR (n.gene = 'rrl' AND b.rich) THEN 0 ELSE 1 END) AS missing
   FROM bugs b JOIN need n ON n.o = b.o JOIN state s ON s.sample_id = b.sample_id GROUP BY ALL)
 SELECT b.sample_id, d.drug, CASE WHEN m.genes IS NULL OR (t = 1 AND missing > 0) OR t IS NULL THEN 'no-call' WHEN t = 3 THEN 'R' WHEN t = 2 THEN 'Uncertain' ELSE 'S' END AS call,
   COALESCE(missing < genes, FALSE) AS target_covered FROM bugs b CROSS JOIN d LEFT JOIN miss m ON m.sample_id = b.sample_id AND m.filed = d.filed LEFT JOIN top ON top.sample_id = b.sample_id AND top.filed = d.filed""",
)
def other_organism_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    see = lambda name: _view(spark, sf_dir, _NTM, name)
    changes = see("changes").withColumn("alt", F.substr("hgvs", F.length("hgvs"), F.lit(1)))
    held = see("bugs").select("sample_id", F.lit("rrl").alias("gene"), F.col("rich").alias("callable"))
    drugs = spark.createDataFrame([("azithromycin",), ("amikacin",)], "drug string")
    return ntm.call_drugs(see("bugs"), changes, ntm.erm41_states(see("erm")), held, drugs).select("sample_id", "drug", "call", "target_covered")


# --- reads and contamination ---

_READS = "reads_of AS (SELECT source AS sample_id, LENGTH(text) AS length, CAST(doc_id % 40 AS DOUBLE) AS quality FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


@query(
    "read_profiles",
    f"""WITH {_READS}, r AS (SELECT *, SUM(length) OVER (PARTITION BY sample_id ORDER BY length DESC) AS upto, SUM(length) OVER (PARTITION BY sample_id) AS bases FROM reads_of),
 p AS (SELECT sample_id, COUNT(*) AS reads, MIN(length) AS min_length, MAX(length) AS max_length, AVG(length) AS mean_length, QUANTILE_CONT(length, 0.5) AS median_length, SUM(CASE WHEN length >= 1000 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS long_share,
   STDDEV_POP(length) / NULLIF(AVG(length), 0) AS variation, AVG(quality) AS mean_quality, MAX(CASE WHEN upto * 2 >= bases THEN length END) AS n50 FROM r GROUP BY sample_id)
 SELECT sample_id, reads, min_length, max_length, ROUND(mean_length, 4) AS mean_length, ROUND(median_length, 4) AS median_length, ROUND(long_share, 6) AS long_share, ROUND(variation, 6) AS length_variation, ROUND(mean_quality, 4) AS mean_quality, n50,
   CASE WHEN long_share >= 0.1 OR median_length >= 1000 THEN 'ont' WHEN max_length <= 400 THEN 'illumina' WHEN median_length > 400 THEN 'ont' ELSE 'illumina' END AS platform, CASE WHEN long_share >= 0.1 OR median_length >= 1000 OR max_length <= 400 THEN 'high' ELSE 'low' END AS confidence FROM p""",
)
def read_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as reads of their source: lengths, N50 and the platform that they look like."""
    out = C.infer_platform(C.read_profile(_view(spark, sf_dir, _READS, "reads_of")))
    digits = {"mean_length": 4, "median_length": 4, "long_share": 6, "length_variation": 6, "mean_quality": 4}
    return out.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()}).select(
        "sample_id", "reads", "min_length", "max_length", *digits, "n50", "platform", "confidence"
    )


_MARKS = "marks AS (SELECT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, CONCAT(CHR(CAST(CASE l_suppkey % 3 WHEN 0 THEN 35 WHEN 1 THEN 66 ELSE 60 END + l_linenumber % 5 AS INT)), CHR(CAST(CASE l_suppkey % 3 WHEN 0 THEN 70 WHEN 1 THEN 90 ELSE 74 END + l_linenumber % 4 AS INT))) AS qual FROM lineitem)"


@query(
    "quality_encodings",
    f"""WITH {_MARKS}, m AS (SELECT sample_id, MIN(LEAST(ASCII(SUBSTR(qual, 1, 1)), ASCII(SUBSTR(qual, 2, 1)))) AS low, MAX(GREATEST(ASCII(SUBSTR(qual, 1, 1)), ASCII(SUBSTR(qual, 2, 1)))) AS high FROM marks GROUP BY sample_id)
 SELECT sample_id, CASE WHEN low < 59 THEN 'phred33' WHEN high > 80 THEN 'phred64' ELSE 'ambiguous' END AS encoding, low, high FROM m""",
)
def quality_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quality_encoding(_view(spark, sf_dir, _MARKS, "marks"))


_ASSIGNED = """
 assigned AS (SELECT CONCAT('O', CAST(o_custkey AS VARCHAR(9))) AS sample_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END AS reads, CAST(o_orderkey % 10 AS DOUBLE) / 100 AS fraction, o_orderstatus <> 'F' AS is_target,
   CASE o_orderkey % 5 WHEN 0 THEN 'genus' WHEN 1 THEN 'complex' ELSE 'species' END AS resolution, CONCAT(' taxon', CAST(o_orderkey % 9 AS VARCHAR(9))) AS name, CASE WHEN o_orderpriority LIKE '1%' THEN 'G' ELSE ' S' END AS rank, CAST(o_orderkey % 100 AS DOUBLE) / 4 AS percentage FROM orders)"""


@query(
    "non_target_reads",
    f"""WITH {_ASSIGNED}, a AS (SELECT sample_id, COALESCE(SUM(reads), 0) AS n, COALESCE(SUM(CASE WHEN NOT is_target THEN reads END), 0) AS other, SUM(CASE WHEN NOT is_target THEN fraction END) AS stated,
   MIN(CASE resolution WHEN 'genus' THEN 0 WHEN 'complex' THEN 1 ELSE 2 END) AS k FROM assigned GROUP BY sample_id), s AS (SELECT *, CASE WHEN n > 0 THEN other * 1.0 / n ELSE stated END AS share FROM a)
 SELECT sample_id, ROUND(share, 6) AS fraction, CASE WHEN share IS NOT NULL THEN CASE k WHEN 0 THEN 'genus' WHEN 1 THEN 'complex' ELSE 'species' END END AS resolution FROM s""",
)
def non_target_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.non_target(_view(spark, sf_dir, _ASSIGNED, "assigned")).withColumn("fraction", F.round("fraction", 6))


@query(
    "foreign_taxa",
    f"""WITH {_ASSIGNED} SELECT sample_id, TRIM(name) AS name, ROUND(percentage / 100, 6) AS share, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY percentage DESC, name) AS rank
 FROM assigned WHERE TRIM(rank) = 'S' AND percentage / 100 > 0.005 AND TRIM(name) NOT LIKE 'taxon3%'""",
)
def foreign_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.foreign_taxa(_view(spark, sf_dir, _ASSIGNED, "assigned"), "taxon3")
    return found.withColumns({"share": F.round("share", 6)})


# --- sites ---

@query(
    "backfilled_fractions",
    with_sql(" SELECT sample_id, variant_id, ROUND(CASE WHEN pos % 2 = 0 THEN 0.5 ELSE alt_reads * 1.0 / depth END, 6) AS allele_fraction FROM variants"),
)
def backfilled_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second position states no fraction, which then comes from the site's counts."""
    stated = view(spark, sf_dir, "variants").withColumn("allele_fraction", F.when(F.col("pos") % 2 == 0, F.lit(0.5)))
    return S.backfill_fractions(stated, view(spark, sf_dir, "sites")).select("sample_id", "variant_id", F.round("allele_fraction", 6).alias("allele_fraction"))


@query(
    "snp_counts",
    with_sql(" SELECT sample_id, chrom, pos, depth - alt_reads AS n_a, CASE alt WHEN 'C' THEN alt_reads ELSE 0 END AS n_c, CASE alt WHEN 'G' THEN alt_reads ELSE 0 END AS n_g, CASE alt WHEN 'T' THEN alt_reads ELSE 0 END AS n_t FROM variants"),
)
def snp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "variants").withColumns({"ref_reads": F.col("depth") - F.col("alt_reads"), "qual": F.lit(30)})
    return S.snp_observations(rows).drop("qual")


@query(
    "contig_names",
    with_sql(
        """ SELECT sample_id, CASE WHEN chrom = 'c1' THEN 'NC_1' WHEN contigs = 1 THEN 'NC_1' ELSE chrom END AS chrom, CAST(COUNT(*) AS BIGINT) AS sites FROM few JOIN (SELECT sample_id, COUNT(DISTINCT chrom) AS contigs FROM few GROUP BY sample_id) n USING (sample_id) GROUP BY 1, 2""",
        " few AS (SELECT sample_id, chrom, pos FROM sites WHERE chrom = 'c2' OR LENGTH(sample_id) > 2)",
    ),
)
def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs under the scheme's names: by alias, or the only one of a sample for the only one of the scheme."""
    few = view(spark, sf_dir, "sites").filter("chrom = 'c2' or length(sample_id) > 2")
    aliases, scheme = spark.createDataFrame([("c1", "NC_1")], "alias string, chrom string"), spark.createDataFrame([("NC_1",)], "chrom string")
    return S.translate_contigs(few, aliases, scheme).groupBy("sample_id", "chrom").agg(F.count("*").alias("sites"))


@query(
    "built_mask",
    with_sql(
        """ SELECT chrom, CAST(MIN(a) AS INT) AS start_pos, CAST(MAX(z) AS INT) AS end_pos FROM (SELECT *, SUM(CASE WHEN a <= top THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run
   FROM (SELECT *, MAX(z) OVER (PARTITION BY chrom ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans) x) y GROUP BY chrom, run""",
        " spans AS (SELECT chrom, start_pos AS a, end_pos AS z FROM mask_raw UNION ALL SELECT chrom, start_pos - 1, end_pos FROM genes)",
    ),
)
def built_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask's own intervals and the genes, one-based, as one merged mask."""
    contigs = view(spark, sf_dir, "contigs")
    genes = I.from_one_based(view(spark, sf_dir, "genes"))
    return I.build_mask([view(spark, sf_dir, "mask_raw"), genes], contigs, 1.0).select("chrom", F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))


# --- cohort ---

@query(
    "pair_states",
    f"""WITH {_CLUSTER_PAIRS} SELECT sample_a, sample_b, CASE WHEN shared_callable_sites < 3000000 THEN 'thin' ELSE 'comparable' END AS state, ROUND(snps * 1e6 / shared_callable_sites, 6) AS snps_per_mb FROM cpairs""",
)
def pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.comparable_pairs(_chain(spark, sf_dir)[1]).select("sample_a", "sample_b", "state", F.round("snps_per_mb", 6).alias("snps_per_mb"))


_FAMILIES = """
 taxa AS (SELECT DISTINCT CONCAT('S', CAST(l_suppkey AS VARCHAR(9))) AS sample_id, CONCAT('lineage', CAST(l_linenumber AS VARCHAR(9)), CASE WHEN l_partkey % 2 = 0 THEN CONCAT('.', CAST(l_partkey % 5 AS VARCHAR(9))) ELSE '' END) AS taxon, l_partkey % 2 = 0 AND l_partkey % 5 < 3 AS bare, l_linenumber AS n FROM lineitem),
 families AS (SELECT sample_id, taxon, CASE WHEN bare THEN '' ELSE CONCAT('family ', taxon) END AS family FROM taxa),
 called AS (SELECT sample_id, MAX(taxon) AS taxon FROM taxa GROUP BY sample_id)"""


@query(
    "applicable_lineages",
    f"""WITH {_FAMILIES}, sp AS (SELECT CONCAT('S', CAST(s_suppkey AS VARCHAR(9))) AS sample_id, CASE s_nationkey % 3 WHEN 0 THEN 'MTBC' WHEN 1 THEN 'MAC' END AS complex FROM supplier)
 SELECT c.sample_id, COALESCE(complex = 'MTBC', FALSE) AS applicable, CASE WHEN complex = 'MTBC' THEN SPLIT_PART(taxon, '.', 1) END AS lineage, CASE WHEN complex = 'MTBC' AND taxon LIKE '%.%' THEN taxon END AS sublineage FROM called c LEFT JOIN sp USING (sample_id)""",
)
def applicable_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _view(spark, sf_dir, _FAMILIES, "called")
    calls = calls.withColumns({"lineage": E.taxon_root(F.col("taxon")), "sublineage": F.when(E.taxon_depth(F.col("taxon")) > 1, F.col("taxon"))})
    species = run_sql(spark, sf_dir, "SELECT CONCAT('S', CAST(s_suppkey AS VARCHAR(9))) AS sample_id, CASE s_nationkey % 3 WHEN 0 THEN 'MTBC' WHEN 1 THEN 'MAC' END AS complex FROM supplier")
    return L.call_where_applicable(calls, species).select("sample_id", "applicable", "lineage", "sublineage")


@query(
    "lineage_families",
    f"""WITH {_FAMILIES} SELECT sample_id, ARG_MAX(family, LENGTH(f.taxon)) AS family FROM called c JOIN families f USING (sample_id)
 WHERE family <> '' AND (f.taxon = c.taxon OR (c.taxon LIKE '%.%' AND f.taxon = SPLIT_PART(c.taxon, '.', 1))) GROUP BY sample_id""",
)
def lineage_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.family_of(_view(spark, sf_dir, _FAMILIES, "families"), _view(spark, sf_dir, _FAMILIES, "called"))
