"""Queries on the annotation of whole variant tables: contigs are the a, c, g and t of the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.operators import annotation as A
from isolates.plans.fixtures import run_sql
from isolates.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UPSTREAM = 20


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _views(every: str, each: Callable[[str], str]) -> str:
    """Contigs, genes of 45 bases and alleles of all kinds; ``every``: the flag of a replacement of all matches, ``each``: rows 0 to n - 1."""
    return f"""
letters AS (SELECT CAST(doc_id AS VARCHAR(20)) AS chrom, UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', ''{every})) AS seq FROM documents WHERE doc_id IS NOT NULL),
contig AS (SELECT chrom, MIN(seq) AS seq FROM letters WHERE LENGTH(seq) >= 70 GROUP BY chrom),
gene_no AS (SELECT chrom, {each("CAST(FLOOR(LENGTH(seq) / 70) AS INT)")} AS i FROM contig),
genes AS (SELECT chrom, CASE WHEN i % 3 = 2 THEN '' ELSE CONCAT('g', CAST(i AS VARCHAR(9))) END AS name, CONCAT('L', chrom, '_', CAST(i AS VARCHAR(9))) AS locus_tag,
  CAST(i * 70 + 11 AS INT) AS start_pos, CAST(i * 70 + 55 AS INT) AS end_pos, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE WHEN i % 5 = 4 THEN 'rRNA' ELSE 'protein_coding' END AS biotype FROM gene_no),
place AS (SELECT chrom, seq, {each("CAST(FLOOR((LENGTH(seq) - 20) / 7) AS INT)")} AS j FROM contig),
spot AS (SELECT chrom, seq, CAST(j AS INT) AS j, CAST(j * 7 + 5 AS INT) AS pos FROM place),
alleles AS (
  SELECT chrom, pos,
    CASE j % 6 WHEN 0 THEN SUBSTR(seq, pos, 1) WHEN 1 THEN SUBSTR(seq, pos, 2) WHEN 2 THEN SUBSTR(seq, pos, j % 4 + 2) WHEN 3 THEN SUBSTR(seq, pos, 1) WHEN 4 THEN SUBSTR(seq, pos, 3) ELSE SUBSTR(seq, pos, 4) END AS ref,
    CASE j % 6 WHEN 0 THEN TRANSLATE(SUBSTR(seq, pos, 1), 'ACGT', 'CGTA') WHEN 1 THEN TRANSLATE(SUBSTR(seq, pos, 2), 'ACGT', 'GTAC') WHEN 2 THEN SUBSTR(seq, pos, 1)
      WHEN 3 THEN CONCAT(SUBSTR(seq, pos, 1), SUBSTR(seq, pos + 1, j % 7 + 1))
      WHEN 4 THEN CONCAT(TRANSLATE(SUBSTR(seq, pos, 1), 'ACGT', 'CGTA'), SUBSTR(seq, pos + 1, 1), TRANSLATE(SUBSTR(seq, pos + 2, 1), 'ACGT', 'TGCA')) ELSE SUBSTR(seq, pos, 1) END AS alt
  FROM spot)"""


_SPARK = _views("", lambda n: f"EXPLODE(SEQUENCE(0, {n} - 1))")
_DUCK = _views(", 'g'", lambda n: f"UNNEST(range(0, {n}))")


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH{_SPARK} SELECT * FROM {name}")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alleles, genes and tiles, each written once: the texts are read three times, not once for each place that uses the genes."""
    alleles, tiles = _view(spark, sf_dir, "alleles").distinct(), A.sequence_tiles(_view(spark, sf_dir, "contig"))
    return materialise(alleles, "alleles"), materialise(_view(spark, sf_dir, "genes"), "genes"), materialise(tiles, "tiles")


# --- pieces of SQL ---


def _aa(codon: str) -> str:
    at = lambda i: f"(INSTR('TCAG', SUBSTR({codon}, {i}, 1)) - 1)"
    return f"CASE WHEN LENGTH({codon}) = 3 THEN SUBSTR('{E.AMINO_ACIDS}', CAST({at(1)} * 16 + {at(2)} * 4 + {at(3)} + 1 AS INT), 1) END"


def _three(residue: str) -> str:
    names = "".join(E.THREE.values())
    return f"SUBSTR('{names}', CAST((INSTR('{''.join(E.THREE)}', {residue}) - 1) * 3 + 1 AS INT), 3)"


def _read(bases: str) -> str:
    return f"CASE WHEN strand = '-' THEN REVERSE(TRANSLATE({bases}, 'ACGT', 'TGCA')) ELSE {bases} END"


def _offset(pos: str) -> str:
    return (
        f"CASE WHEN strand = '+' THEN CASE WHEN {pos} >= start_pos THEN {pos} - start_pos + 1 ELSE {pos} - start_pos END "
        f"ELSE CASE WHEN {pos} <= end_pos THEN end_pos - {pos} + 1 ELSE end_pos - {pos} END END"
    )


_GENES = f"""
label AS (SELECT *, CASE WHEN name = '' THEN locus_tag ELSE name END AS gene, biotype = 'protein_coding' AS coding,
  CASE WHEN strand = '+' THEN start_pos - {UPSTREAM} ELSE start_pos END AS low, CASE WHEN strand = '+' THEN end_pos ELSE end_pos + {UPSTREAM} END AS high FROM genes),
allele AS (SELECT DISTINCT chrom, pos, ref, alt FROM alleles),
pair AS (SELECT a.*, g.* EXCLUDE (chrom), pos BETWEEN start_pos AND end_pos AS inside FROM allele a JOIN label g ON g.chrom = a.chrom AND a.pos BETWEEN g.low AND g.high),
best AS (
  SELECT p.*, seq, CASE WHEN coding THEN 'c.' ELSE 'n.' END AS prefix FROM pair p JOIN contig USING (chrom)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY inside DESC, CASE WHEN inside THEN end_pos - start_pos ELSE ABS({_offset("pos")}) END, start_pos, gene) = 1)"""

_NAMES = f"""{_GENES},
change AS (
  SELECT *, pos + i - 1 AS bp, SUBSTR(ref, i, 1) AS r, SUBSTR(alt, i, 1) AS a
  FROM (SELECT *, LIST_MIN(LIST_FILTER(range(1, LENGTH(ref) + 1), lambda x: SUBSTR(ref, x, 1) <> SUBSTR(alt, x, 1))) AS i FROM best WHERE LENGTH(ref) = LENGTH(alt))),
numbered AS (SELECT *, CASE WHEN coding AND c > 0 THEN (c - 1) // 3 + 1 END AS number FROM (SELECT *, {_offset("bp")} AS c FROM change)),
placed AS (SELECT *, CASE WHEN strand = '+' THEN start_pos + (number - 1) * 3 ELSE end_pos - number * 3 + 1 END AS first FROM numbered),
codon AS (
  SELECT *, SUBSTR(seq, first, 3) AS g,
    ARRAY_TO_STRING(LIST_TRANSFORM(range(0, 3), lambda k: CASE WHEN first + k = bp THEN a ELSE SUBSTR(seq, first + k, 1) END), '') AS g_one,
    ARRAY_TO_STRING(LIST_TRANSFORM(range(0, 3), lambda k: CASE WHEN first + k BETWEEN pos AND pos + LENGTH(ref) - 1 THEN SUBSTR(alt, CAST(first + k - pos + 1 AS INT), 1) ELSE SUBSTR(seq, first + k, 1) END), '') AS g_all
  FROM placed),
turned AS (SELECT *, {_read("g")} AS k0, {_read("g_one")} AS k1, {_read("g_all")} AS k2 FROM codon),
residue AS (SELECT *, {_aa("k0")} AS before, {_aa("k1")} AS one, {_aa("k2")} AS whole FROM turned),
sub AS (
  SELECT chrom, pos, ref, alt, gene, locus_tag,
    CASE WHEN i IS NULL THEN NULL
         WHEN LENGTH(ref) > 1 AND before <> whole THEN CONCAT('p.', {_three("before")}, number, {_three("whole")})
         WHEN number > 1 AND before <> one THEN CONCAT('p.', {_three("before")}, number, {_three("one")})
         ELSE CONCAT(prefix, c, {_read("r")}, '>', {_read("a")}) END AS hgvs,
    CASE WHEN i IS NULL THEN 'no_change'
         WHEN LENGTH(ref) > 1 AND before <> whole THEN CASE WHEN whole = '*' THEN 'stop_gained' WHEN number = 1 THEN 'start_lost' ELSE 'missense_variant' END
         WHEN c < 0 THEN 'upstream_variant' WHEN NOT coding THEN 'non_coding_variant' WHEN number = 1 THEN 'start_lost'
         WHEN before = one THEN 'synonymous_variant' WHEN one = '*' THEN 'stop_gained' ELSE 'missense_variant' END AS effect
  FROM residue),
measured AS (
  SELECT *, ABS(LENGTH(alt) - LENGTH(ref)) AS size, LENGTH(alt) < LENGTH(ref) AS del, {_offset("pos")} AS c,
         {_offset("(pos + 1)")} AS c1, {_offset("(pos + ABS(LENGTH(alt) - LENGTH(ref)))")} AS c2 FROM best WHERE LENGTH(ref) <> LENGTH(alt)),
edge AS (SELECT *, LEAST(c1, c2) AS lo, GREATEST(c1, c2) AS hi, CASE WHEN strand = '+' THEN c ELSE c - 1 END AS lft, CASE WHEN strand = '+' THEN c + 1 ELSE c END AS touched FROM measured),
indel AS (
  SELECT *, CASE WHEN NOT coding THEN 'non_coding_variant' WHEN CASE WHEN del THEN hi ELSE touched END < 1 THEN 'upstream_variant' WHEN del AND lo < 1 THEN 'start_lost'
                 WHEN size % 3 <> 0 THEN 'frameshift_variant' WHEN del THEN 'inframe_deletion' ELSE 'inframe_insertion' END AS effect FROM edge),
named AS (
  SELECT chrom, pos, ref, alt, gene, locus_tag, hgvs, effect FROM sub
  UNION ALL
  SELECT chrom, pos, ref, alt, gene, locus_tag,
    CASE WHEN effect = 'frameshift_variant' THEN CONCAT('p.Xaa', (CASE WHEN del THEN lo ELSE touched END - 1) // 3 + 1, 'fs')
         WHEN del THEN CONCAT(prefix, CASE WHEN size = 1 THEN CONCAT(lo) ELSE CONCAT(lo, '_', hi) END, 'del', {_read("SUBSTR(ref, 2, CAST(size AS INT))")})
         ELSE CONCAT(prefix, lft, '_', lft + 1, 'ins', {_read("SUBSTR(alt, 2, CAST(size AS INT))")}) END AS hgvs, effect FROM indel)"""


@query(
    "annotated_variants",
    f"WITH{_DUCK},{_NAMES} SELECT a.chrom, a.pos, a.ref, a.alt, gene, locus_tag, hgvs, COALESCE(effect, 'intergenic_variant') AS effect FROM allele a LEFT JOIN named n USING (chrom, pos, ref, alt)",
)
def annotated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, blocks, insertions and deletions of all contigs, named in one job."""
    alleles, genes, tiles = _inputs(spark, sf_dir)
    return A.annotate(alleles, genes, tiles, UPSTREAM).select(*A.ALLELE, "gene", "locus_tag", "hgvs", "effect")


@query(
    "protein_indels",
    f"""WITH{_DUCK},{_GENES},
inside AS (
  SELECT p.*, SUBSTR(seq, start_pos, end_pos - start_pos + 1) AS cds, pos - start_pos AS o FROM pair p JOIN contig USING (chrom)
  WHERE inside AND coding AND LENGTH(ref) <> LENGTH(alt)),
fit AS (SELECT *, CONCAT(SUBSTR(cds, 1, o), alt, SUBSTR(cds, CAST(o + 1 + LENGTH(ref) AS INT))) AS changed FROM inside WHERE SUBSTR(cds, CAST(o + 1 AS INT), LENGTH(ref)) = ref),
read_as AS (SELECT *, {_read("cds")} AS x, {_read("changed")} AS y FROM fit),
made AS (
  SELECT *, ARRAY_TO_STRING(LIST_TRANSFORM(range(0, LENGTH(x) // 3), lambda i: {_aa("SUBSTR(x, CAST(i * 3 + 1 AS INT), 3)")}), '') AS old,
            ARRAY_TO_STRING(LIST_TRANSFORM(range(0, LENGTH(y) // 3), lambda i: {_aa("SUBSTR(y, CAST(i * 3 + 1 AS INT), 3)")}), '') AS new FROM read_as),
headed AS (SELECT *, LEN(LIST_FILTER(range(1, LEAST(LENGTH(old), LENGTH(new)) + 1), lambda i: SUBSTR(old, 1, i) = SUBSTR(new, 1, i))) AS head FROM made),
tailed AS (SELECT *, LEN(LIST_FILTER(range(1, LEAST(LENGTH(old), LENGTH(new)) - head + 1), lambda i: RIGHT(old, i) = RIGHT(new, i))) AS tail FROM headed),
sized AS (SELECT *, LENGTH(old) - head - tail AS gone, LENGTH(new) - head - tail AS more, SUBSTR(new, head + 1, LENGTH(new) - head - tail) AS added FROM tailed),
moved AS (
  SELECT *, head + 1 + LEN(LIST_FILTER(range(1, LENGTH(old) - head - gone + 1), lambda i: SUBSTR(old, head + 1, i) = SUBSTR(old, head + gone + 1, i))) AS first,
         head + LIST_MIN(LIST_FILTER(range(0, LENGTH(old) + 1), lambda i: SUBSTR(old, head + i + 1, more) <> added OR head + i >= LENGTH(old))) AS before FROM sized)
SELECT chrom, pos, ref, alt, gene,
  CASE WHEN (LENGTH(alt) - LENGTH(ref)) % 3 <> 0 THEN NULL
       WHEN gone = 1 AND more = 0 THEN CONCAT('p.', {_three("SUBSTR(old, first, 1)")}, first, 'del')
       WHEN gone > 0 AND more = 0 THEN CONCAT('p.', {_three("SUBSTR(old, first, 1)")}, first, '_', {_three("SUBSTR(old, first + gone - 1, 1)")}, first + gone - 1, 'del')
       WHEN more > 0 AND gone = 0 AND before - more >= 0 AND SUBSTR(old, before - more + 1, more) = added THEN
         CASE WHEN more = 1 THEN CONCAT('p.', {_three("added")}, before, 'dup') ELSE CONCAT('p.', {_three("SUBSTR(added, 1, 1)")}, before - more + 1, '_', {_three("RIGHT(added, 1)")}, before, 'dup') END
       WHEN more > 0 AND gone = 0 AND before BETWEEN 1 AND LENGTH(old) - 1 THEN
         CONCAT('p.', {_three("SUBSTR(old, before, 1)")}, before, '_', {_three("SUBSTR(old, before + 1, 1)")}, before + 1, 'ins', ARRAY_TO_STRING(LIST_TRANSFORM(range(1, more + 1), lambda i: {_three("SUBSTR(added, CAST(i AS INT), 1)")}), ''))
  END AS protein,
  CASE WHEN ((LENGTH(alt) - LENGTH(ref)) % 3 <> 0 OR LENGTH(new) < LENGTH(old)) AND head < LENGTH(old) THEN CONCAT('p.', {_three("SUBSTR(old, head + 1, 1)")}, head + 1, 'fs') END AS frameshift
FROM moved""",
)
def protein_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions and deletions inside genes, at the level of residues."""
    alleles, genes, tiles = _inputs(spark, sf_dir)
    pairs = A.gene_pairs(alleles.filter("length(ref) <> length(alt)"), genes, upstream=UPSTREAM).filter("within")
    pairs = pairs.select(*A.ALLELE, "gene", "start_pos", "strand")
    return A.protein_changes(pairs, A.coding_sequences(genes, tiles)).select(*A.ALLELE, "gene", "protein", "frameshift")


@query(
    "left_aligned",
    f"""WITH RECURSIVE{_DUCK},
step AS (
  SELECT DISTINCT chrom, pos, ref, alt, pos AS p, ref AS r, alt AS a, 0 AS k FROM alleles
  UNION ALL
  SELECT s.chrom, s.pos, s.ref, s.alt,
    CASE WHEN LENGTH(r) > 1 AND LENGTH(a) > 1 THEN p ELSE p - 1 END,
    CASE WHEN LENGTH(r) > 1 AND LENGTH(a) > 1 THEN LEFT(r, LENGTH(r) - 1) ELSE CONCAT(SUBSTR(seq, p - 1, 1), r) END,
    CASE WHEN LENGTH(r) > 1 AND LENGTH(a) > 1 THEN LEFT(a, LENGTH(a) - 1) ELSE CONCAT(SUBSTR(seq, p - 1, 1), a) END, k + 1
  FROM step s JOIN contig USING (chrom) WHERE RIGHT(r, 1) = RIGHT(a, 1) AND (LENGTH(r) > 1 AND LENGTH(a) > 1 OR p > 1)),
last AS (SELECT * FROM step QUALIFY ROW_NUMBER() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY k DESC) = 1),
head AS (SELECT *, LEN(LIST_FILTER(range(1, LEAST(LENGTH(r), LENGTH(a))), lambda i: SUBSTR(r, 1, i) = SUBSTR(a, 1, i))) AS h FROM last)
SELECT chrom, pos, ref, alt, CAST(p + h AS INT) AS new_pos, SUBSTR(r, h + 1) AS new_ref, SUBSTR(a, h + 1) AS new_alt, 0 AS n_filters FROM head""",
)
def left_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every allele trimmed and at its leftmost place."""
    alleles, _, tiles = _inputs(spark, sf_dir)
    own = [F.col(c).alias(f"old_{c}") for c in ("pos", "ref", "alt")]
    moved = A.normalise_variants(alleles.select("*", *own), tiles)
    return moved.select("chrom", *[F.col(f"old_{c}").alias(c) for c in ("pos", "ref", "alt")], *[F.col(c).alias(f"new_{c}") for c in ("pos", "ref", "alt")], F.size("filters").alias("n_filters"))


# --- every name ---

_KEYS = "chrom, pos, ref, alt"


def _base_chain(source: str, to: str) -> str:
    """View ``to``: the name of a changed base (bp, r, a) of ``source`` in the row's gene, and its codon ``number``."""
    return f"""
{to}_n AS (SELECT *, CASE WHEN coding AND c > 0 THEN (c - 1) // 3 + 1 END AS number FROM (SELECT *, {_offset("bp")} AS c, CASE WHEN coding THEN 'c.' ELSE 'n.' END AS prefix FROM {source})),
{to}_p AS (SELECT *, CASE WHEN strand = '+' THEN start_pos + (number - 1) * 3 ELSE end_pos - number * 3 + 1 END AS first FROM {to}_n),
{to}_c AS (
  SELECT *, SUBSTR(seq, first, 3) AS g, ARRAY_TO_STRING(LIST_TRANSFORM(range(0, 3), lambda k: CASE WHEN first + k = bp THEN a ELSE SUBSTR(seq, first + k, 1) END), '') AS g_one,
    ARRAY_TO_STRING(LIST_TRANSFORM(range(0, 3), lambda k: CASE WHEN first + k BETWEEN pos AND pos + LENGTH(ref) - 1 AND first + k BETWEEN start_pos AND end_pos THEN SUBSTR(alt, CAST(first + k - pos + 1 AS INT), 1) ELSE SUBSTR(seq, first + k, 1) END), '') AS g_all
  FROM {to}_p),
{to}_t AS (SELECT *, {_read("g")} AS k0, {_read("g_one")} AS k1, {_read("g_all")} AS k2 FROM {to}_c),
{to}_r AS (SELECT *, {_aa("k0")} AS before, {_aa("k1")} AS one, {_aa("k2")} AS whole FROM {to}_t),
{to} AS (SELECT *, CASE WHEN number > 1 AND before <> one THEN CONCAT('p.', {_three("before")}, number, {_three("one")}) ELSE CONCAT(prefix, c, {_read("r")}, '>', {_read("a")}) END AS said FROM {to}_r)"""


def _indel_chain(source: str, to: str) -> str:
    """View ``to``: the nucleotide name of an insertion or deletion of ``source`` in the row's gene."""
    return f"""
{to}_m AS (
  SELECT *, ABS(LENGTH(alt) - LENGTH(ref)) AS size, LENGTH(alt) < LENGTH(ref) AS del, {_offset("pos")} AS c, CASE WHEN coding THEN 'c.' ELSE 'n.' END AS prefix,
         {_offset("(pos + 1)")} AS c1, {_offset("(pos + ABS(LENGTH(alt) - LENGTH(ref)))")} AS c2 FROM {source}),
{to}_e AS (SELECT *, LEAST(c1, c2) AS lo, GREATEST(c1, c2) AS hi, CASE WHEN strand = '+' THEN c ELSE c - 1 END AS lft, CASE WHEN strand = '+' THEN c + 1 ELSE c END AS touched FROM {to}_m),
{to} AS (
  SELECT *, CASE WHEN coding AND size % 3 <> 0 AND (CASE WHEN del THEN lo ELSE touched END) >= 1 THEN CONCAT('p.Xaa', (CASE WHEN del THEN lo ELSE touched END - 1) // 3 + 1, 'fs')
    WHEN del THEN CONCAT(prefix, CASE WHEN size = 1 THEN CONCAT(lo) ELSE CONCAT(lo, '_', hi) END, 'del', {_read("SUBSTR(ref, 2, CAST(size AS INT))")})
    ELSE CONCAT(prefix, lft, '_', lft + 1, 'ins', {_read("SUBSTR(alt, 2, CAST(size AS INT))")}) END AS said FROM {to}_e)"""


_LOSS = "effect IN ('" + "', '".join(A.LOSS) + "') OR (hgvs LIKE 'p.%' AND hgvs LIKE '%Ter')"
_PROTEIN = SQL["protein_indels"].split("fit AS", 1)[1].rsplit("\nSELECT chrom", 1)
_PROTEIN_NAMES = SQL["protein_indels"].rsplit("\nSELECT chrom, pos, ref, alt, gene,", 1)[1]

_ALL_NAMES = f"""{_NAMES},
wide AS (SELECT p.*, seq FROM pair p JOIN contig USING (chrom)),
side AS (SELECT w.* FROM wide w LEFT JOIN best b USING ({_KEYS}) WHERE NOT w.inside AND w.gene IS DISTINCT FROM b.gene),
side_base AS (
  SELECT *, pos + i - 1 AS bp, SUBSTR(ref, i, 1) AS r, SUBSTR(alt, i, 1) AS a
  FROM (SELECT *, LIST_MIN(LIST_FILTER(range(1, LENGTH(ref) + 1), lambda x: SUBSTR(ref, x, 1) <> SUBSTR(alt, x, 1))) AS i FROM side WHERE LENGTH(ref) = LENGTH(alt)) WHERE i IS NOT NULL),
{_base_chain("side_base", "sb")},
side_indel AS (SELECT * FROM side WHERE LENGTH(ref) <> LENGTH(alt)),
{_indel_chain("side_indel", "si")},
cut AS (SELECT *, SUBSTR(ref, 2) AS gone, SUBSTR(alt, 2) AS more, GREATEST(pos - 40, 1) AS base FROM allele JOIN contig USING (chrom) WHERE LENGTH(ref) <> LENGTH(alt)),
local AS (SELECT *, SUBSTR(seq, base, 120) AS was, CONCAT(SUBSTR(seq, base, pos - base), alt, SUBSTR(seq, CAST(pos + LENGTH(ref) AS INT), CAST(120 - (pos - base) - LENGTH(ref) AS INT))) AS now FROM cut),
shift AS (SELECT *, UNNEST(range(GREATEST(pos - 24, 1), pos + 25)) AS at_pos FROM local),
moved_to AS (
  SELECT chrom, pos AS own_pos, ref AS own_ref, alt AS own_alt, seq, CAST(at_pos AS INT) AS pos, was, now, base,
    CASE WHEN gone <> '' THEN SUBSTR(was, CAST(at_pos - base + 1 AS INT), LENGTH(gone) + 1) ELSE SUBSTR(was, CAST(at_pos - base + 1 AS INT), 1) END AS ref,
    CASE WHEN gone <> '' THEN SUBSTR(was, CAST(at_pos - base + 1 AS INT), 1) ELSE SUBSTR(now, CAST(at_pos - base + 1 AS INT), LENGTH(more) + 1) END AS alt FROM shift),
put AS (
  SELECT chrom, own_pos, own_ref, own_alt, pos, ref, alt FROM moved_to
  WHERE LENGTH(ref) > 0 AND LENGTH(alt) > 0 AND LENGTH(ref) - LENGTH(alt) = LENGTH(own_ref) - LENGTH(own_alt) AND SUBSTR(ref, 1, 1) = SUBSTR(alt, 1, 1)
    AND CONCAT(SUBSTR(was, 1, pos - base), alt, SUBSTR(was, CAST(pos - base + 1 + LENGTH(ref) AS INT))) = now),
put_genes AS (SELECT p.*, g.* EXCLUDE (chrom), pos BETWEEN start_pos AND end_pos AS inside FROM put p JOIN label g ON g.chrom = p.chrom AND p.pos BETWEEN g.low AND g.high),
put_in AS (SELECT * FROM put_genes QUALIFY inside OR NOT BOOL_OR(inside) OVER (PARTITION BY chrom, own_pos, own_ref, own_alt, pos)),
{_indel_chain("put_in", "pi")},
inside AS (SELECT p.*, SUBSTR(seq, start_pos, end_pos - start_pos + 1) AS cds, pos - start_pos AS o FROM put_in p JOIN contig USING (chrom) WHERE coding AND pos >= start_pos),
fit AS{_PROTEIN[0]},
product AS (SELECT chrom, own_pos, own_ref, own_alt, gene,{_PROTEIN_NAMES.rsplit("FROM moved", 1)[0]} FROM moved),
base_at AS (
  SELECT a.chrom, a.pos, a.ref, a.alt, seq, i, a.pos + i - 1 AS bp, SUBSTR(a.ref, i, 1) AS r, SUBSTR(a.alt, i, 1) AS a
  FROM (SELECT *, UNNEST(range(1, LENGTH(ref) + 1)) AS i FROM allele WHERE LENGTH(ref) = LENGTH(alt) AND LENGTH(ref) > 1) a JOIN contig USING (chrom) WHERE SUBSTR(a.ref, i, 1) <> SUBSTR(a.alt, i, 1)),
base_genes AS (SELECT b.*, g.* EXCLUDE (chrom), bp BETWEEN start_pos AND end_pos AS inside FROM base_at b JOIN label g ON g.chrom = b.chrom AND b.bp BETWEEN g.low AND g.high),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEYS}, i ORDER BY inside DESC, CASE WHEN inside THEN end_pos - start_pos ELSE ABS({_offset("bp")}) END, start_pos, gene) AS n FROM base_genes),
meant AS (SELECT *, FIRST_VALUE(gene) OVER (PARTITION BY {_KEYS}, i ORDER BY n) AS main FROM ranked),
block_base AS (SELECT * FROM meant WHERE n = 1 OR (NOT inside AND gene <> main)),
{_base_chain("block_base", "bb")},
block AS (SELECT *, {_offset("pos")} AS c1, {_offset("(pos + LENGTH(ref) - 1)")} AS c2 FROM best WHERE inside AND LENGTH(ref) = LENGTH(alt) AND LENGTH(ref) > 1),
ending AS (SELECT * FROM named WHERE {_LOSS} OR regexp_matches(hgvs, '^p\\.Ter[0-9]')),
every AS (
  SELECT {_KEYS}, gene, hgvs AS name FROM named
  UNION SELECT {_KEYS}, gene, said FROM sb UNION SELECT {_KEYS}, gene, said FROM si UNION SELECT {_KEYS}, gene, said FROM bb
  UNION SELECT chrom, own_pos, own_ref, own_alt, gene, said FROM pi
  UNION SELECT chrom, own_pos, own_ref, own_alt, gene, protein FROM product UNION SELECT chrom, own_pos, own_ref, own_alt, gene, frameshift FROM product
  UNION SELECT chrom, own_pos, own_ref, own_alt, gene, 'LoF' FROM product WHERE frameshift IS NOT NULL
  UNION SELECT {_KEYS}, gene, CONCAT('p.', {_three("before")}, number, {_three("whole")}) FROM bb WHERE n = 1 AND inside AND before <> whole
  UNION SELECT {_KEYS}, gene, 'LoF' FROM bb WHERE n = 1 AND inside AND before <> whole AND (whole = '*' OR number = 1)
  UNION SELECT {_KEYS}, gene, CONCAT(prefix, LEAST(c1, c2), '_', GREATEST(c1, c2), 'del', {_read("ref")}, 'ins', {_read("alt")}) FROM block
  UNION SELECT {_KEYS}, gene, 'LoF' FROM named WHERE {_LOSS}
  UNION SELECT {_KEYS}, p.gene, 'LoF' FROM pair p JOIN ending e USING ({_KEYS}) WHERE p.coding
  UNION SELECT a.chrom, pos, ref, alt, gene, 'LoF' FROM allele a JOIN label g ON g.chrom = a.chrom AND g.coding AND LENGTH(ref) > LENGTH(alt) AND start_pos <= pos + LENGTH(ref) - LENGTH(alt) AND end_pos >= pos + 1)"""


@query("legitimate_names", f"WITH{_DUCK},{_ALL_NAMES} SELECT {_KEYS}, gene, name FROM every WHERE name IS NOT NULL")
def legitimate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name under which a catalogue may hold each allele."""
    alleles, genes, tiles = _inputs(spark, sf_dir)
    return A.legitimate_names(alleles, genes, tiles, UPSTREAM)
