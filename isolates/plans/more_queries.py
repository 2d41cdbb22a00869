"""Registered queries on gene names, species, checks, reports and text review, with SQL where it can be expressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.operators import checks as Q
from isolates.operators import cohort
from isolates.operators import contamination as X
from isolates.operators import coverage as C
from isolates.operators import intervals as I
from isolates.operators import lineage as L
from isolates.operators import naming as N
from isolates.operators import report as P
from isolates.operators import species as Z
from isolates.operators import resistance as R
from isolates.operators import textaudit as T
from isolates.plans.cohort_queries import _CLUSTER_PAIRS, _CLUSTERS, _CONSENSUS, _VARIANTS, _chain, contributions, variants
from isolates.plans.fixtures import run_sql, view, with_sql
from isolates.plans.typing_queries import _GENOTYPES, _VALIDITY, _panel, _support
from isolates.session import materialise, read_table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NAMED = """
 met AS (
  SELECT v.sample_id, v.variant_id, v.pos, v.ref, v.alt, g.name, g.strand, v.pos BETWEEN g.start_pos AND g.end_pos AS inside, g.end_pos - g.start_pos AS size,
    CASE WHEN g.strand = '+' THEN CASE WHEN v.pos >= g.start_pos THEN v.pos - g.start_pos + 1 ELSE v.pos - g.start_pos END
         ELSE CASE WHEN v.pos <= g.end_pos THEN g.end_pos - v.pos + 1 ELSE g.end_pos - v.pos END END AS off
  FROM variants v JOIN genes g ON g.chrom = v.chrom AND v.pos BETWEEN CASE WHEN g.strand = '+' THEN g.start_pos - 100 ELSE g.start_pos END AND CASE WHEN g.strand = '+' THEN g.end_pos ELSE g.end_pos + 100 END),
 best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, variant_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN size ELSE ABS(off) END, name) AS i FROM met) m WHERE i = 1)"""


@query(
    "gene_names",
    with_sql(
        """
 SELECT v.sample_id, v.variant_id, b.name AS gene,
        CASE WHEN b.name IS NULL THEN NULL WHEN b.strand = '+' THEN CONCAT('c.', CAST(off AS VARCHAR), v.ref, '>', v.alt) ELSE CONCAT('c.', CAST(off AS VARCHAR), TRANSLATE(v.ref, 'ACGT', 'TGCA'), '>', TRANSLATE(v.alt, 'ACGT', 'TGCA')) END AS hgvs,
        CASE WHEN b.name IS NULL THEN 'intergenic_variant' WHEN off < 0 THEN 'upstream_variant' ELSE 'coding_variant' END AS effect
 FROM variants v LEFT JOIN best b ON b.sample_id = v.sample_id AND b.variant_id = v.variant_id""",
        _NAMED,
    ),
)
def gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = N.gene_context(view(spark, sf_dir, "variants"), view(spark, sf_dir, "genes"), upstream=100)
    return N.name_substitutions(context).select("sample_id", "variant_id", "gene", "hgvs", "effect")


_MATCHES = """
 ani AS (SELECT CONCAT('S', CAST(ps_suppkey AS VARCHAR(9))) AS sample_id, p_brand AS name, CASE p_size % 4 WHEN 0 THEN 'MTBC' WHEN 1 THEN 'MAC' END AS complex,
   90 + p_size / 5.0 AS ani, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size % 10) / 10.0 END AS aligned_fraction
   FROM (SELECT DISTINCT l_suppkey AS ps_suppkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey) x)"""


@query(
    "species_calls",
    f"WITH{_MATCHES},"
    + """
 best_per AS (SELECT sample_id, name, ani, MIN(complex) AS complex, MIN(aligned_fraction) AS aligned_fraction FROM ani GROUP BY sample_id, name, ani),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY ani DESC, name) AS i FROM best_per),
 p AS (SELECT sample_id, COUNT(DISTINCT CASE WHEN ani >= 95 THEN name END) AS passing FROM ani GROUP BY sample_id)
 SELECT r.sample_id, CASE WHEN ani < 95 THEN 'unresolved' WHEN COALESCE(aligned_fraction < 0.6, FALSE) OR complex IN ('MTBC', 'MAC') THEN COALESCE(complex, 'unresolved') ELSE name END AS name,
        CASE WHEN ani >= 95 THEN COALESCE(complex, '') END AS complex, ROUND(CAST(ani AS DOUBLE), 6) AS ani,
        ani >= 95 AND NOT COALESCE(aligned_fraction < 0.6, FALSE) AND complex IS NULL AS resolved,
        CASE WHEN ani < 95 THEN 'none' WHEN COALESCE(aligned_fraction < 0.6, FALSE) THEN 'low' WHEN complex = 'MTBC' THEN CASE WHEN aligned_fraction IS NULL THEN 'moderate' ELSE 'high' END
             WHEN complex = 'MAC' OR passing > 1 OR aligned_fraction IS NULL THEN 'moderate' ELSE 'high' END AS confidence
 FROM r JOIN p USING (sample_id) WHERE i = 1""",
)
def species_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_sql(spark, sf_dir, f"WITH{_MATCHES} SELECT * FROM ani")
    per = raw.groupBy("sample_id", "name", "ani").agg(F.min("complex").alias("complex"), F.min("aligned_fraction").cast("double").alias("aligned_fraction"))
    out = Z.identify(per.withColumn("ani", F.col("ani").cast("double")))
    return out.select("sample_id", "name", "complex", F.round("ani", 6).alias("ani"), "resolved", "confidence")


def _mixed(code: str) -> str:
    """The finalizer of splitmix64 over a column, 63 bits of it."""
    times = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"
    step = lambda x, n: f"xor({x}, {x} >> {n})"
    return f"(SELECT {step('y', 31)} >> 1 FROM (SELECT {times(step('z', 27), 0x94D049BB133111EB)} AS y FROM (SELECT {times(step('w', 30), 0xBF58476D1CE4E5B9)} AS z FROM (SELECT CAST({code} AS UBIGINT) AS w))))"


_K, _SIZE = 15, 200
_CODED = " + ".join(f"(INSTR('ACGT', SUBSTR(m, {i + 1}, 1)) - 1) * {4 ** (_K - 1 - i)}" for i in range(_K))
_SKETCHES = f"""
 texts AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', '', 'g')) AS seq FROM documents
   UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', '', 'g')) FROM benchmark),
 mer AS (SELECT DISTINCT side, id, LEAST(m, REVERSE(TRANSLATE(m, 'ACGT', 'TGCA'))) AS m FROM (SELECT side, id, SUBSTR(seq, CAST(UNNEST(range(1, LENGTH(seq) - {_K} + 2)) AS INT), {_K}) AS m FROM texts WHERE LENGTH(seq) >= {_K})),
 coded AS (SELECT side, id, {_CODED} AS code FROM mer),
 hashed AS (SELECT DISTINCT side, id, {_mixed("code")} AS hash FROM coded),
 sketch AS (SELECT side, id, hash FROM hashed QUALIFY ROW_NUMBER() OVER (PARTITION BY side, id ORDER BY hash) <= {_SIZE}),
 sizes AS (SELECT side, id, COUNT(*) AS n FROM sketch GROUP BY side, id),
 common AS (SELECT q.id AS query, r.id AS reference, COUNT(*) AS shared FROM sketch q JOIN sketch r ON q.hash = r.hash AND q.side = 'd' AND r.side = 'i' GROUP BY ALL)"""


@query(
    "sketch_identity",
    f"""WITH{_SKETCHES} SELECT query, reference, shared, ROUND(shared * 1.0 / (a.n + b.n - shared), 6) AS jaccard,
 ROUND(100 * (1 + LN(2 * (shared * 1.0 / (a.n + b.n - shared)) / (1 + shared * 1.0 / (a.n + b.n - shared))) / {_K}), 6) AS ani
 FROM common JOIN sizes a ON a.side = 'd' AND a.id = query JOIN sizes b ON b.side = 'i' AND b.id = reference""",
)
def sketch_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity between the letters a, c, g and t of texts and those of benchmark items."""
    letters = lambda c: F.upper(F.regexp_replace(F.lower(c), "[^acgt]", ""))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), letters(F.col("text")).alias("seq"))
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), letters(F.col("text")).alias("seq"))
    found = Z.sketch_identity(Z.sketches(docs, _K, _SIZE), Z.sketches(items, _K, _SIZE), _K)
    return found.select("query", "reference", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("ani", 6).alias("ani"))


_METRICS = _VALIDITY + ", metrics AS (SELECT sample_id, breadth, het AS het_fraction, f2, f47 FROM mix)"


@query(
    "check_rows",
    with_sql(
        """
 SELECT sample_id, name, ROUND(value, 6) AS value, CASE WHEN value IS NULL THEN 'warn' WHEN name = 'het_fraction' AND value > 0.05 THEN 'fail' WHEN name = 'het_fraction' AND value > 0.01 THEN 'warn'
   WHEN name = 'breadth' AND value < 0.95 THEN 'warn' WHEN name IN ('f2', 'f47') AND value > 0.05 THEN 'warn' ELSE 'pass' END AS status, value IS NOT NULL AS measured
 FROM (SELECT sample_id, 'breadth' AS name, CAST(breadth AS DOUBLE) AS value FROM metrics UNION ALL SELECT sample_id, 'het_fraction', het_fraction FROM metrics UNION ALL SELECT sample_id, 'f2', f2 FROM metrics
   UNION ALL SELECT sample_id, 'f47', f47 FROM metrics UNION ALL SELECT sample_id, UNNEST(['mean_depth', 'evenness', 'mapped_fraction', 'non_target_fraction']), NULL FROM metrics) x""",
        _METRICS,
    ),
)
def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _panel(spark, sf_dir).select("sample_id", "breadth", "het_fraction", "f2", "f47")
    return Q.evaluate(metrics).select("sample_id", "name", F.round("value", 6).alias("value"), "status", "measured")


@query("overall_status", with_sql(" SELECT sample_id, CASE WHEN het_fraction > 0.05 THEN 'fail' ELSE 'warn' END AS status FROM metrics", _METRICS))
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _panel(spark, sf_dir).select("sample_id", "breadth", "het_fraction", "f2", "f47")
    return Q.overall(Q.evaluate(metrics)).select("sample_id", "status")


@query(
    "drug_report",
    with_sql(
        """
 SELECT d.sample_id, d.drug, d.call, COALESCE(MAX(CASE WHEN catalogue = 'WHO' THEN c END), 'not-consulted') AS "call_WHO", COALESCE(MAX(CASE WHEN catalogue = 'flat' THEN c END), 'not-consulted') AS call_flat,
        COALESCE(MAX(CASE WHEN catalogue = 'third' THEN c END), 'not-consulted') AS call_third
 FROM decided d LEFT JOIN (SELECT sample_id, drug, catalogue, CASE sev WHEN 0 THEN 'S' WHEN 1 THEN 'S-interim' WHEN 3 THEN 'Uncertain' WHEN 4 THEN 'R-interim' ELSE 'R' END AS c FROM headline) h USING (sample_id, drug)
 GROUP BY d.sample_id, d.drug, d.call""",
        _CONSENSUS,
    ),
)
def drug_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = contributions(spark, sf_dir)
    return P.drug_rows(R.consensus(parts, "illumina"), parts).select("sample_id", "drug", "call", "call_WHO", "call_flat", "call_third")


@query(
    "variant_report",
    with_sql(
        """
 SELECT v.sample_id, v.variant_id, CASE m.sev WHEN 0 THEN 'S' WHEN 1 THEN 'S-interim' WHEN 3 THEN 'Uncertain' WHEN 4 THEN 'R-interim' WHEN 6 THEN 'R' END AS worst_call, m.grades
 FROM v LEFT JOIN (SELECT sample_id, variant_id, MAX(sev) AS sev, STRING_AGG(DISTINCT catalogue || ':' || drug || '=' || grade, ';' ORDER BY catalogue || ':' || drug || '=' || grade) AS grades FROM parts GROUP BY ALL) m USING (sample_id, variant_id)""",
        _CONSENSUS,
    ),
)
def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.variant_rows(variants(spark, sf_dir), contributions(spark, sf_dir)).select("sample_id", "variant_id", "worst_call", "grades")


@query("cohort_summary")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = R.consensus(contributions(spark, sf_dir), "illumina")
    sites = materialise(view(spark, sf_dir, "sites"), "sites")
    return P.cohort_summary(L.call_lineages(_support(spark, sf_dir, sites)), X.sample_validity(_panel(spark, sf_dir, sites)), calls)


_TURNS = """
 turns AS (SELECT conv_id, turn, role, text, LAG(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations),
 answers AS (SELECT CONCAT(CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20))) AS answer_id, text AS answer, before AS context FROM turns WHERE role = 'assistant')"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH{_TURNS} SELECT * FROM answers")


@query("answer_sentences", f"WITH{_TURNS} SELECT answer_id, COUNT(*) AS sentences FROM (SELECT answer_id, UNNEST(regexp_extract_all(answer, '[^.!?;\\n]+[.!?;\\n]?')) AS s FROM answers) x WHERE TRIM(s) <> '' GROUP BY answer_id")
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentence_rows(_answers(spark, sf_dir)).groupBy("answer_id").agg(F.count("*").alias("sentences"))


#: Answers, the evidence and the facts about each, and the rule that it breaks; {n} is a number of the evidence.
_REVIEWS = [
    ("The depth was {n}x over all sites.", "depth {n}", "", None),
    ("The depth was {n}00x.", "depth {n}", "", "unsupported-number"),
    ("Depth came to {n}.3x.", "depth {n}.26", "", None),
    ("   ", "depth {n}", "", "empty"),
    ("The contamination screen came back clean.", "", "unmeasured=taxonomic_contamination_screen", "unmeasured-as-settled"),
    ("No second organism was seen.", "", "unmeasured=non_target_fraction", "unmeasured-as-settled"),
    ("Sequencing coverage is excellent.", "", "unmeasured=mean_depth", "unmeasured-as-settled"),
    ("The screen was not informative, so purity is unknown and nothing is ruled out.", "", "unmeasured=taxonomic_contamination_screen", None),
    ("GC was normal.", "", "unmeasured=gc_fraction", "unmeasured-as-settled"),
    ("The ligcat was normal.", "", "unmeasured=gc_fraction", None),
    ("Sequencing coverage is excellent.", "", "unmeasured=transmission_cluster", None),
    ("The isolate is susceptible to INH.", "", "no_determinant=Isoniazid", "susceptible-for-no-determinant"),
    ("Pyrazinamide is susceptible.", "", "unevaluable=Pyrazinamide", "susceptible-for-no-determinant"),
    ("The isolate is fully susceptible.", "", "", "susceptible-for-no-determinant"),
    ("The isolate is fully susceptible.", "", "no_determinant=Isoniazid", None),
    ("There is no doubt at all here that the isolate is susceptible to rifampin.", "", "no_determinant=Rifampicin", "susceptible-for-no-determinant"),
    ("This is not proof it is sensitive to rifampin.", "", "no_determinant=Rifampicin", None),
    ("It cannot be assumed that the isolate is susceptible to rifampicin.", "", "no_determinant=Rifampicin", None),
    ("Phenotypic susceptibility testing is required to settle isoniazid.", "", "no_determinant=Isoniazid", None),
    ("RIF remains active.", "", "resistant=rifampicin", "contradicts-drug-call"),
    ("Rmp can still be used; the rest is open.", "", "resistant=Rifampicin", "contradicts-drug-call"),
    ("Rifampicin remains active, but only in part.", "", "resistant=rifampicin", None),
    ("The isolate is resistant to DCS as well.", "", "uncertain=cycloserine", "contradicts-drug-call"),
    ("Resistance to moxifloxacin was not called.", "", "no_determinant=MFX", None),
    ("Eth is resistant to nothing that we looked for.", "", "no_determinant=ethionamide", None),
    ("The sample is clean.", "", "validity=suspect", "contradicts-validity"),
    ("The sample is reliable.", "", "validity=suspect", None),
    ("The sample is reliable.", "", "validity=invalid", "contradicts-validity"),
    ("The sample is reliable.", "", "validity=valid", None),
    ("The sample is fit for purpose.", "", "", "contradicts-validity"),
    ("The run is insufficient to be usable.", "", "validity=invalid", None),
    ("While depth was low, the sample is acceptable.", "", "validity=invalid", None),
    ("There were no major issues with this run.", "", "validity=suspect", "contradicts-validity"),
    ("This is M. bovis.", "M. tuberculosis", "", "invented-organism"),
    ("A member of the Mycobacterium tuberculosis complex.", "M. tuberculosis", "", None),
    ('{"choice": "pass", "headline": "Depth was {n}x."}', "depth {n}", "choice=pass", None),
    ('{"choice": "pass", "headline": "Depth was {n}x."}', "depth {n}", "choice=warn", "overrides-rule"),
    ('{"choice": "probably fine", "confidence": 0.93, "headline": "All."}', "", "choice=pass", "outside-option-set"),
]


def _case(column: int) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "CASE k " + " ".join(f"WHEN {i} THEN {text(r[column])}" for i, r in enumerate(_REVIEWS)) + " END"


_REVIEWED = f" cases AS (SELECT CAST(p_partkey AS VARCHAR(20)) AS answer_id, CAST(p_partkey % {len(_REVIEWS)} AS INT) AS k, CAST(p_size + 10 AS VARCHAR(9)) AS n FROM part)"


@query("answer_review", f"WITH{_REVIEWED} SELECT answer_id, {_case(3)} IS NULL AS ok, {_case(3)} AS rule FROM cases")
def answer_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds with facts of all kinds; the SQL states what each should come to, by hand."""
    rows = run_sql(spark, sf_dir, f"WITH{_REVIEWED} SELECT answer_id, k, REPLACE({_case(0)}, '{{n}}', n) AS answer, REPLACE({_case(1)}, '{{n}}', n) AS context, {_case(2)} AS facts FROM cases")
    pair = F.split("fact", "=")
    facts = rows.filter("facts <> ''").select("answer_id", F.explode(F.split("facts", ";")).alias("fact")).select("answer_id", pair[0].alias("kind"), pair[1].alias("term"))
    plain = F.startswith("answer", F.lit("{"))
    free = T.review(rows.filter(~plain), facts)
    closed = T.review(rows.filter(plain), facts.unionByName(rows.filter(plain).select("answer_id", F.lit("validity").alias("kind"), F.lit("valid").alias("term"))), ["pass", "warn", "fail"])
    return free.unionByName(closed).select("answer_id", "ok", "rule")


_RUNS = " texts AS (SELECT doc_id, CONCAT(text, ' ', REPEAT(CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'N' ELSE 'gT' END, CAST(40 + doc_id % 20 AS INT)), CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE 'x' END) AS text FROM documents)"


@query("sequence_leaks", f"WITH{_RUNS} SELECT doc_id FROM texts WHERE regexp_matches(text, '[ACGTNacgtn]{{50,}}')")
def sequence_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a run of 50 bases or more; runs of 40 to 118 letters are put behind the given texts, which have none."""
    return run_sql(spark, sf_dir, f"WITH{_RUNS} SELECT * FROM texts").filter(T.looks_like_sequence(F.col("text"))).select("doc_id")


_SEQ = " seqs AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, UPPER(regexp_replace(LOWER(text), '[^acgt]', '', 'g')) AS seq FROM documents)"


@query("homopolymers", f"WITH{_SEQ} SELECT chrom, CAST(SUM(LENGTH(run)) AS BIGINT) AS bases FROM (SELECT chrom, UNNEST(regexp_extract_all(seq, 'A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}}')) AS run FROM seqs) x GROUP BY chrom".replace("{{", "{").replace("}}", "}"))
def homopolymers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    seqs = docs.select(F.col("doc_id").cast("string").alias("chrom"), F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))
    found = I.homopolymers(seqs, 4)
    return found.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("long").alias("bases"))


@query(
    "assembly_stats",
    f"""WITH{_SEQ}, c AS (SELECT source, LENGTH(seq) AS length, LENGTH(seq) - LENGTH(REPLACE(REPLACE(seq, 'G', ''), 'C', '')) AS gc FROM (SELECT source, UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', '', 'g')) AS seq FROM documents) x WHERE seq IS NOT NULL),
 r AS (SELECT *, SUM(length) OVER (PARTITION BY source ORDER BY length DESC) AS upto, SUM(length) OVER (PARTITION BY source) AS bases FROM c)
 SELECT source AS sample_id, COUNT(*) AS contigs, CAST(SUM(length) AS BIGINT) AS bases, MAX(CASE WHEN upto * 2 >= bases THEN length END) AS n50, ROUND(SUM(gc) * 1.0 / NULLIF(SUM(length), 0), 6) AS gc, CAST(0 AS BIGINT) AS ambiguous FROM r GROUP BY source""",
)
def assembly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters a, c, g and t of each text are a contig, the texts of a source one assembly."""
    seqs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))
    out = C.assembly_stats(seqs.filter("seq is not null"))
    return out.withColumns({"gc": F.round("gc", 6), "n50": F.col("n50").cast("long"), "contigs": F.col("contigs").cast("long"), "ambiguous": F.col("ambiguous").cast("long")})


@query("natural_order", "SELECT CONCAT('S', CAST(c_custkey AS VARCHAR)) AS name, ROW_NUMBER() OVER (ORDER BY c_custkey) AS place FROM customer")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample names in natural order: S2 before S10."""
    names = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("name"))
    # numbered without one task for all: places by leading key length, then within
    keyed = names.withColumn("key", E.natural_key(F.col("name"))).withColumn("group", F.length("name"))
    sizes = keyed.groupBy("group").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.select(F.col("group").alias("g"), F.col("n").alias("m")), F.col("g") < F.col("group"), "left").groupBy("group").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("group").orderBy("key"))
    return keyed.withColumn("i", place).join(F.broadcast(before), "group").select("name", (F.col("before") + F.col("i")).cast("long").alias("place"))


@query(
    "gene_probe_coverage",
    with_sql(
        """
 SELECT s.sample_id, p.name || '@' || p.chrom AS gene, ROUND(COUNT(d.pos) * 1.0 / COUNT(*), 6) AS body_coverage, COUNT(d.pos) = COUNT(*) AS callable
 FROM (SELECT DISTINCT sample_id FROM sites) s CROSS JOIN (SELECT DISTINCT name, chrom, CAST(start_pos + ROUND(i * (end_pos - start_pos) / 6.0) AS INT) AS pos FROM genes CROSS JOIN (SELECT UNNEST(RANGE(0, 7)) AS i) x) p
 LEFT JOIN depths d ON d.sample_id = s.sample_id AND d.chrom = p.chrom AND d.pos = p.pos AND d.depth >= 20 GROUP BY s.sample_id, p.name, p.chrom"""
    ),
)
def gene_probe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isolates.operators import ntm

    genes = view(spark, sf_dir, "genes").withColumn("name", F.concat("name", F.lit("@"), "chrom"))
    return ntm.gene_coverage(view(spark, sf_dir, "sites"), genes, depth=20).withColumn("body_coverage", F.round("body_coverage", 6))


_MARKERS = """
 markers AS (SELECT CONCAT('sp', CAST(FLOOR(p_partkey / 4) AS VARCHAR(9))) AS species, CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END AS chrom, CAST(p_partkey AS INT) + 1 AS pos, 'A' AS allele FROM part)"""


@query(
    "marker_species",
    with_sql(
        """
 SELECT sample_id, CASE WHEN COUNT(*) = 1 THEN MIN(species) END AS marker_species, COUNT(*) > 1 AS conflict FROM (
  SELECT g.sample_id, m.species FROM geno g JOIN markers m ON m.chrom = g.chrom AND m.pos = g.pos WHERE g.depth >= 3 GROUP BY g.sample_id, m.species HAVING BOOL_AND(COALESCE(g.allele = m.allele, FALSE))) x GROUP BY sample_id""",
        _GENOTYPES + "," + _MARKERS,
    ),
)
def marker_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = run_sql(spark, sf_dir, f"WITH{_MARKERS} SELECT * FROM markers")
    return Z.genotype_markers(view(spark, sf_dir, "sites"), markers)


@query(
    "distance_rows",
    f"""WITH RECURSIVE {_CLUSTER_PAIRS},{_CLUSTERS.format(t=1)},
 member AS (SELECT c.sample_id, i.cluster_id FROM cust c LEFT JOIN comp k ON k.node = c.sample_id LEFT JOIN ids i USING (root))
 SELECT p.sample_a, p.sample_b, p.snps, p.snps <= 1 AS within, p.shared_callable_sites >= 3000000 AS sufficient, COALESCE(a.cluster_id = b.cluster_id, FALSE) AS same_cluster
 FROM cpairs p JOIN member a ON a.sample_id = p.sample_a JOIN member b ON b.sample_id = p.sample_b""",
)
def distance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, found = _chain(spark, sf_dir)
    found = materialise(found, "pairs")
    return P.distance_rows(found, cohort.cluster_members(samples, found, 1), 1, 3_000_000).select("sample_a", "sample_b", "snps", "within", "sufficient", "same_cluster")


@query(
    "disagreements",
    with_sql(" SELECT sample_id, drug, call, 'biological' AS disagreement_kind FROM graded WHERE disagreement", _CONSENSUS),
)
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.disagreement_rows(R.consensus(contributions(spark, sf_dir), "illumina")).drop("supporting_variants")


@query(
    "joint_site_counts",
    with_sql(" SELECT chrom, COUNT(*) AS sites, CAST(SUM(samples) AS BIGINT) AS alleles FROM (SELECT chrom, pos, COUNT(*) AS samples FROM v WHERE pass GROUP BY chrom, pos) x GROUP BY chrom", _VARIANTS),
)
def joint_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cohort.joint_alleles(cohort.usable_variants(variants(spark, sf_dir)))
    return kept.groupBy("chrom", "pos").agg(F.count("*").alias("n")).groupBy("chrom").agg(F.count("*").alias("sites"), F.sum("n").alias("alleles"))


@query("scheme_gaps", "SELECT r_name AS member, CONCAT('La', CAST(r_regionkey AS VARCHAR)) AS root FROM region WHERE CONCAT('La', CAST(r_regionkey AS VARCHAR)) NOT IN (SELECT DISTINCT CONCAT('La', CAST(p_size % 3 AS VARCHAR)) FROM part)")
def scheme_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("member"), F.concat(F.lit("La"), F.col("r_regionkey").cast("string")).alias("root"))
    scheme = read_table(spark, sf_dir, "part").select(F.concat(F.lit("La"), (F.col("p_size") % 3).cast("string"), F.lit(".1")).alias("taxon"))
    return L.scheme_gaps(scheme, members).select("member", "root")
