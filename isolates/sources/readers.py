"""Readers of sequencing formats as DataFrames: text read by Spark in splits, parsed by column expressions.

Each reader takes a path or glob and returns rows with ``sample_id`` from the file name (its stem up to the first
point), so that one call reads many samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import drugs as D
from isolates.functions import expressions as E
from isolates.sources.splits import read_fasta, read_fasta_pieces, read_fastq  # noqa: F401

# Ambiguity codes of bases.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def sample_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(sample_from_path(F.input_file_name()).alias("sample_id"), F.col("value"))


def _checked(rows: DataFrame, bad: Column, what: str) -> DataFrame:
    """``rows``; reading one for which ``bad`` holds is an error."""
    return rows.filter(F.assert_true(~F.coalesce(bad, F.lit(True)), F.lit(what)).isNull())


def read_lengths(fastq: DataFrame) -> DataFrame:
    """(sample_id, length, quality) of reads, quality as the mean phred of its marks."""
    marks = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return fastq.select("sample_id", F.length("seq").alias("length"), E.ratio(F.aggregate(marks, F.lit(0), lambda a, x: a + x), F.size(marks)).alias("quality"))


SITES = "sample_id string, chrom string, pos int, ref_base string, n_a long, n_c long, n_g long, n_t long, n_n long, n_gap long, raw_depth int, covered boolean, ins map<string,int>, del map<string,int>"


def pileup_counts(bases: Column, ref: Column) -> dict[str, Column]:
    """Base counts n_a to n_gap and the inserted and deleted sequences of a pileup column, as expressions.

    ``^`` swallows the mark after it, ``$`` and a sign without a number stand for nothing; after a sign and a number so
    many bases are an insertion or deletion, what follows them is counted again. ``.`` and ``,`` are the reference base.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(bases, F.lit("")), r"\^.", ""), r"\$|[+-](?![0-9])", "")
    token = r"([+-])([0-9]+)([^+-]*)"
    part = lambda i: F.regexp_extract_all(clean, F.lit(token), i)
    events = F.arrays_zip(part(1).alias("sign"), part(2).alias("n"), part(3).alias("rest"))
    plain = F.concat(F.regexp_extract(clean, r"^[^+-]*", 0), F.array_join(F.transform(events, lambda e: F.substr(e["rest"], e["n"].cast("int") + 1)), ""))
    count = lambda letters: F.length(F.regexp_replace(plain, f"[^{letters}]", "")).cast("long")
    same = count(".,")
    out = {}
    for name, letter in (("n_a", "A"), ("n_c", "C"), ("n_g", "G"), ("n_t", "T"), ("n_n", "N")):
        out[name] = count(letter + letter.lower()) + F.when(ref == letter, same).otherwise(0)
    out["n_gap"] = count("*#")

    def kinds(sign: str) -> Column:
        words = F.transform(F.filter(events, lambda e: e["sign"] == sign), lambda e: F.upper(F.substr(e["rest"], F.lit(1), e["n"].cast("int"))))
        one = F.array_distinct(words)
        return F.map_from_arrays(one, F.transform(one, lambda k: F.size(F.filter(words, lambda w: w == k))))

    return out | {"ins": kinds("+"), "del": kinds("-")}


def read_mpileup(spark: SparkSession, path: str) -> DataFrame:
    """Allele counts from pileup text; a row of depth zero is a site that is not covered. Rows without a position are left out."""
    cut = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.size(cut) >= 4)
    rows = rows.select("sample_id", cut[0].alias("chrom"), cut[1].try_cast("int").alias("pos"), F.upper(cut[2]).alias("ref_base"), cut[3].try_cast("int").alias("raw_depth"), F.get(cut, F.lit(4)).alias("bases"))
    rows = rows.filter("pos is not null")
    counts = pileup_counts(F.when(F.col("raw_depth") > 0, F.col("bases")), F.col("ref_base"))
    rows = rows.select("*", *[c.alias(n) for n, c in counts.items()], F.coalesce(F.col("raw_depth") > 0, F.lit(False)).alias("covered"))
    return rows.select(*[F.col(f.split()[0]).alias(f.split()[0]) for f in SITES.replace("map<string,int>", "map").split(", ")])


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, chrom, pos, depth) from three-column depth text; malformed lines are left out."""
    cut = F.split("value", "\t")
    rows = _lines(spark, path).select("sample_id", cut[0].alias("chrom"), F.get(cut, F.lit(1)).try_cast("int").alias("pos"), F.get(cut, F.lit(2)).try_cast("int").alias("depth"))
    return rows.filter("pos is not null and depth is not null")


def read_library_stats(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, reads, mapped, duplicates, gc) from SN lines and the read-weighted GCF and GCL rows."""
    cut = F.split("value", "\t")
    rows = _lines(spark, path).select("sample_id", cut[0].alias("kind"), F.get(cut, F.lit(1)).alias("a"), F.get(cut, F.lit(2)).alias("b"))
    value = lambda key: F.max(F.when((F.col("kind") == "SN") & (F.col("a") == key), F.col("b").try_cast("long")))
    gc = F.col("kind").isin("GCF", "GCL")
    share, n = F.col("a").try_cast("double") / 100, F.col("b").try_cast("double")
    return rows.groupBy("sample_id").agg(
        value("raw total sequences:").alias("reads"), value("reads mapped:").alias("mapped"), value("reads duplicated:").alias("duplicates"),
        E.ratio(F.sum(F.when(gc, share * n)), F.sum(F.when(gc, n))).alias("gc"),
    )


def read_vcf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, contigs): the sample columns and the declared contigs of each file."""
    lines = _vcf_lines(spark, path).filter(F.startswith("value", F.lit("#")))
    cut = F.split("value", "\t")
    contig = F.nullif(F.regexp_extract("value", r"^##contig=<(?:.*,)?ID=([^,>]+)", 1), F.lit(""))
    samples = F.when(F.startswith("value", F.lit("#CHROM")), F.slice(cut, 10, F.greatest(F.size(cut) - 9, F.lit(0))))
    return lines.groupBy("path").agg(F.first(samples, ignorenulls=True).alias("samples"), F.sort_array(F.collect_set(contig)).alias("contigs"))


def _vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample and alternative allele: depth, read counts and allele fraction.

    Sample columns come from each file's header. A file of one sample, or of none, is the sample that its name says; in a
    file of several each column is a sample by its own name. Any number of FORMAT fields is read, values that are missing
    at the end are NULL. Counts come from AD where it has a number for every allele (or one, for one allele), else from
    AO and RO; the fraction is over the reads counted, else over DP, else AF. A sample whose genotype has no alternative
    is kept: marking is not deleting. Symbolic, missing and spanning alleles (<*>, <NON_REF>, *, .) are left out, so are
    rows with fewer than eight columns. ``variant_id`` is the coordinate key.
    """
    cut = F.split("value", "\t")
    field = lambda i: F.get(cut, F.lit(i))
    rows = _vcf_lines(spark, path).filter(~F.startswith("value", F.lit("#")) & (F.size(cut) >= 8))
    values = F.when(F.size(cut) >= 10, F.slice(cut, 10, F.greatest(F.size(cut) - 9, F.lit(1)))).otherwise(F.array(F.lit("")))
    rows = rows.select("path", cut.alias("cut"), F.posexplode(values).alias("column", "values"))
    field = lambda i: F.get("cut", F.lit(i))
    rows = rows.join(read_vcf_headers(spark, path).select("path", "samples"), "path", "left")
    several = F.size(F.coalesce("samples", F.array().cast("array<string>"))) > 1
    sample = F.when(several, F.get("samples", F.col("column"))).otherwise(sample_from_path(F.col("path")))
    keys = F.coalesce(F.split(field(8), ":"), F.array().cast("array<string>"))
    padded = F.slice(F.concat(F.split("values", ":"), F.array_repeat(F.lit(None).cast("string"), F.size(keys))), F.lit(1), F.size(keys))
    rows = rows.select(
        sample.alias("sample_id"), field(0).alias("chrom"), field(1).try_cast("int").alias("pos"), F.upper(field(3)).alias("ref"), F.split(field(4), ",").alias("alts"), field(5).try_cast("double").alias("qual"),
        F.when(field(6).isin("PASS", "."), F.array(F.lit("PASS"))).otherwise(F.split(field(6), ";")).alias("filters"),
        F.str_to_map(field(7), F.lit(";"), F.lit("=")).alias("info"), F.map_from_arrays(keys, padded).alias("fmt"),
    )
    info = lambda key: F.coalesce(F.col("fmt")[key], F.col("info")[key])
    numbers = lambda text: F.transform(F.split(text, ","), lambda x: x.try_cast("long"))
    rows = rows.withColumns({"ad": numbers(F.col("fmt")["AD"]), "ao": numbers(info("AO")), "ro": info("RO").try_cast("long"), "dp": info("DP").try_cast("long"), "af": F.split(info("AF"), ","), "of": F.size("alts")})
    rows = rows.select("*", F.posexplode("alts").alias("i", "alt")).filter(~F.col("alt").isin("<*>", "<NON_REF>", "*", "."))
    whole, lone = F.size("ad") == F.col("of") + 1, (F.size("ad") == 1) & (F.col("of") == 1)
    from_ad = F.when(whole, F.get("ad", F.col("i") + 1)).when(lone, F.get("ad", F.lit(0)))
    alt_reads = F.coalesce(from_ad, F.get("ao", F.col("i")))
    ref_reads = F.when(from_ad.isNull() & F.get("ao", F.col("i")).isNotNull(), F.col("ro")).when(whole, F.get("ad", F.lit(0)))
    rows = rows.withColumns({"alt_reads": alt_reads, "ref_reads": ref_reads})
    counted = F.aggregate(F.slice("ad", F.lit(1), F.col("of") + 1), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    both = F.col("ref_reads").isNotNull() & F.col("alt_reads").isNotNull()
    total = F.when(both, F.coalesce(F.nullif(counted, F.lit(0)), F.col("ref_reads") + F.col("alt_reads"))).otherwise(F.col("dp"))
    fraction = F.coalesce(E.ratio("alt_reads", total), F.get("af", F.col("i")).try_cast("double"))
    depth = F.coalesce(F.col("dp"), F.nullif(counted, F.lit(0)), F.col("alt_reads") + F.col("ref_reads"))
    return rows.select(
        "sample_id", E.coordinate_key().alias("variant_id"), "chrom", "pos", "ref", F.upper("alt").alias("alt"), E.variant_type(F.col("ref"), F.upper("alt")).alias("variant_type"),
        depth.alias("depth"), "ref_reads", "alt_reads", fraction.alias("allele_fraction"), "qual", "filters",
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, chrom, start_pos, end_pos) of a BED file; an empty or reversed interval is an error."""
    cut = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    rows = rows.select(F.col("sample_id").alias("set_id"), cut[0].alias("chrom"), F.get(cut, F.lit(1)).try_cast("int").alias("start_pos"), F.get(cut, F.lit(2)).try_cast("int").alias("end_pos"))
    return _checked(rows, (F.col("start_pos") >= F.col("end_pos")) | (F.col("start_pos") < 0), "a BED interval is empty, reversed or no number")


def read_barcode(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, taxon, alleles, family, spoligotype, rd); the position is the END column, IUPAC codes become their bases."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|\s*$)"))
    clean = lambda i: F.when(F.coalesce(F.get(cut, F.lit(i)), F.lit("None")).isin("None", "-", ""), "").otherwise(F.get(cut, F.lit(i)))
    codes = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    alleles = F.filter(F.split(codes[F.upper(cut[4])], ""), lambda b: b != "")
    return rows.select(cut[0].alias("chrom"), cut[2].cast("int").alias("pos"), cut[3].alias("taxon"), alleles.alias("alleles"), clean(5).alias("family"), clean(6).alias("spoligotype"), clean(7).alias("rd"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(name, locus_tag, chrom, start_pos, end_pos, strand, biotype) of gene and pseudogene rows; a name equal to the locus tag is none."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(cut) >= 9))
    rows = rows.select(cut[0].alias("chrom"), cut[2].alias("type"), cut[3].cast("int").alias("start_pos"), cut[4].cast("int").alias("end_pos"), cut[6].alias("strand"), F.str_to_map(cut[8], F.lit(";"), F.lit("=")).alias("a"))
    product = F.lower(F.col("a")["product"])
    # Names of the ribosomal genes by product.
    ribosomal = F.when(product.contains("16s ribosomal rna"), "rrs").when(product.contains("23s ribosomal rna"), "rrl").when(product.contains("5s ribosomal rna"), "rrf")
    rna = rows.filter("type = 'rRNA'").select(F.col("a")["Parent"].alias("parent"), ribosomal.alias("rna")).dropDuplicates(["parent"])
    genes = rows.filter(F.col("type").isin("gene", "pseudogene") | F.col("type").endswith("_gene")).withColumn("gid", F.col("a")["ID"])
    locus = F.col("a")["locus_tag"]
    named = F.coalesce(F.col("a")["gene"], F.col("a")["Name"])
    out = genes.join(rna, F.col("gid") == F.col("parent"), "left")
    return out.select(F.coalesce("rna", F.when(named != locus, named), locus, named).alias("name"), locus.alias("locus_tag"), "chrom", "start_pos", "end_pos", "strand", F.coalesce(F.col("a")["gene_biotype"], F.lit("protein_coding")).alias("biotype"))


def read_classifier_report(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, percentage, clade_reads, direct_reads, rank, taxid, name, malformed): malformed rows are kept and marked."""
    cut = F.split("value", "\t")
    field = lambda i: F.get(cut, F.lit(i))
    rows = _lines(spark, path).filter(F.trim("value") != "")
    rows = rows.select("sample_id", F.trim(field(0)).try_cast("double").alias("percentage"), field(1).try_cast("long").alias("clade_reads"), field(2).try_cast("long").alias("direct_reads"), field(3).alias("rank"), field(4).alias("taxid"), F.trim(field(5)).alias("name"))
    return rows.withColumn("malformed", F.col("percentage").isNull() | F.col("clade_reads").isNull() | F.col("name").isNull())


def require_some_rows(report: DataFrame) -> DataFrame:
    """``report`` of :func:`read_classifier_report` without its malformed rows; an error if a sample has no other."""
    only = report.groupBy("sample_id").agg(F.bool_and("malformed").alias("all")).filter("all")
    bad = [r["sample_id"] for r in only.select("sample_id").sort("sample_id").limit(5).collect()]
    if bad:
        raise ValueError(f"no row of the report can be read for {', '.join(bad)}")
    return report.filter(~F.col("malformed"))


def read_ani(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(sample_id, reference, ani, aligned_fraction) of tool output: ``skani`` by column names, ``mash`` as (1 - distance) * 100."""
    if tool == "skani":
        rows = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("sample_id", sample_from_path(F.input_file_name()))
        return rows.select("sample_id", F.col("Ref_file").alias("reference"), F.col("ANI").cast("double").alias("ani"), (F.col("Align_fraction_query").cast("double") / 100).alias("aligned_fraction"))
    if tool != "mash":
        raise ValueError(f"tool is skani or mash; got {tool!r}")
    cut = F.split("value", "\t")
    return _lines(spark, path).select("sample_id", cut[0].alias("reference"), ((1 - cut[2].cast("double")) * 100).alias("ani"), F.lit(None).cast("double").alias("aligned_fraction"))


def read_paf_repeats(spark: SparkSession, path: str, min_length: int = 200, min_identity: float = 0.90) -> DataFrame:
    """(chrom, start_pos, end_pos) of both sides of self-alignments, the trivial diagonal left out."""
    cut = F.split("value", "\t")
    n = lambda i: F.get(cut, F.lit(i)).cast("int")
    rows = spark.read.text(path).filter(F.size(cut) >= 11)
    rows = rows.select(cut[0].alias("q"), n(2).alias("qs"), n(3).alias("qe"), cut[5].alias("t"), n(7).alias("ts"), n(8).alias("te"), n(9).alias("matches"), n(10).alias("block"))
    rows = rows.filter(~((F.col("q") == F.col("t")) & (F.col("qs") == F.col("ts")) & (F.col("qe") == F.col("te"))) & (F.col("block") >= min_length) & (F.col("matches") >= min_identity * F.col("block")))
    sides = F.array(F.struct(F.col("q").alias("chrom"), F.col("qs").alias("start_pos"), F.col("qe").alias("end_pos")), F.struct(F.col("t").alias("chrom"), F.col("ts").alias("start_pos"), F.col("te").alias("end_pos")))
    return rows.select(F.explode(sides).alias("x")).select("x.*")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a sequence index."""
    cut = F.split("value", "\t")
    return spark.read.text(path).select(cut[0].alias("chrom"), cut[1].cast("long").alias("length"))


def read_catalogue_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(name, chrom, pos, ref, alt), a row for each graded name that a coordinate row lists."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.explode(F.split("variant", "&")).alias("name"), F.col("chromosome").alias("chrom"), F.col("position").cast("int").alias("pos"), F.upper("reference_nucleotide").alias("ref"), F.upper("alternative_nucleotide").alias("alt")).withColumn("name", F.trim("name"))


def read_catalogue_coordinates_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(name, chrom, pos, ref, alt) of a VCF whose INFO lists graded names (``graded_variant=a&b``); other rows are left out."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(cut) >= 8))
    listed = F.regexp_extract(cut[7], r"(?:^|;)graded_variant=([^;]*)", 1)
    rows = rows.select(F.explode(F.split(listed, "&")).alias("name"), cut[0].alias("chrom"), cut[1].try_cast("int").alias("pos"), F.upper(cut[3]).alias("ref"), F.upper(cut[4]).alias("alt"))
    return rows.withColumn("name", F.trim("name")).filter("name <> ''")


def read_third_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(catalogue, drug, gene, hgvs, grade, call, comment) of a CSV with gene, mutation, drug, confidence and type: a grade
    in the confidence column decides, else a resistance row is R and any other Uncertain."""
    rows = spark.read.option("header", True).csv(path)
    grade = D.grade_number(F.col("confidence"))
    call = F.coalesce(E.call_for_grade(grade), F.when(F.lower("type").contains("resistance"), "R").otherwise("Uncertain"))
    return rows.select(F.lit("third").alias("catalogue"), D.drug_name(F.col("drug")).alias("drug"), F.col("gene"), F.col("mutation").alias("hgvs"), grade.alias("grade"), call.alias("call"), F.coalesce("comment", F.lit("")).alias("comment"))


def read_graded_catalogue(spark: SparkSession, path: str, header_row: int = 2) -> DataFrame:
    """The graded workbook as (catalogue, drug, gene, hgvs, name, grade, call, comment, rule_only).

    The header stands on the third row; columns are found by name, and the workbook's position column, which does not
    hold one position a name, is not read. A few tens of thousands of rows are parsed on the driver. Additional rules that the
    table only states (their grade rests on a rule) are marked.
    """
    import pandas as pd

    table = pd.read_excel(path, header=header_row, dtype=str) if path.endswith((".xlsx", ".xls")) else pd.read_csv(path, header=header_row, dtype=str, sep="\t")
    table.columns = [str(c).strip() for c in table.columns]
    wanted = {"drug": "drug", "gene": "gene", "mutation": "hgvs", "variant": "name", "FINAL CONFIDENCE GRADING": "grading", "Comment": "comment", "Additional grading criteria applied": "rule"}
    missing = [c for c in wanted if c not in table.columns and c not in ("Comment", "Additional grading criteria applied")]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in row {header_row + 1}")
    kept = table[[c for c in wanted if c in table.columns]].rename(columns=wanted).reindex(columns=list(wanted.values()))
    rows = spark.createDataFrame(kept.astype(object).where(kept.notna(), None), ", ".join(f"{c} string" for c in wanted.values()))
    grade = D.grade_number(F.col("grading"))
    return rows.filter("drug is not null and name is not null").select(
        F.lit("WHO").alias("catalogue"), D.drug_name(F.col("drug")).alias("drug"), "gene", "hgvs", "name", grade.alias("grade"), E.call_for_grade(grade).alias("call"),
        F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce(F.col("rule").rlike("(?i)rule|criteri"), F.lit(False)).alias("rule_only"),
    )


# Drug classes of the flat list and what they stand for.
DRUG_CLASSES = {"fluoroquinolones": ["levofloxacin", "moxifloxacin"], "aminoglycosides": ["amikacin", "kanamycin"]}


def read_flat_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The flat list as (catalogue, drug, gene, hgvs, pos, ref, alt, call): a row for each drug, always R.

    Rows marked phylogenetic are skipped, drug classes become their drugs, and only single bases keep coordinates.
    Columns: position, ref, alt, gene, change, drugs, remark; the file is Latin-1.
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    rows = rows.filter(~F.coalesce(F.lower("remark").contains("phylo"), F.lit(False)))
    classes = F.create_map(*[x for k, v in DRUG_CLASSES.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    named = F.filter(F.transform(F.split("drugs", r"[;,/]"), lambda d: F.lower(F.trim(F.regexp_replace(d, r"\([^)]*\)", "")))), lambda d: d != "")
    drugs = F.array_distinct(F.flatten(F.transform(named, lambda d: F.coalesce(classes[d], F.array(D.drug_name(d))))))
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    return rows.select(
        F.lit("flat").alias("catalogue"), F.explode(drugs).alias("drug"), "gene", F.col("change").alias("hgvs"), F.when(single, F.col("position").try_cast("int")).alias("pos"),
        F.when(single, F.upper("ref")).alias("ref"), F.when(single, F.upper("alt")).alias("alt"), F.lit("R").alias("call"),
    )


def read_reference_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("reference", "name", "accession")) -> DataFrame:
    """A tab-separated manifest with a header; lines that begin with # are comments, a missing column is an error."""
    rows = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    return rows


def resolve_references(matches: DataFrame, manifest: DataFrame) -> DataFrame:
    """``matches`` (reference as a tool wrote it) with the manifest's name and complex: by path, file name, name or accession."""
    last = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    stem = lambda c: F.regexp_replace(last(c), r"\.(fa|fna|fasta)(\.gz)?$", "")
    ref = F.col("reference")
    keys = manifest.select("name", *[c for c in ("complex",) if c in manifest.columns], F.explode(F.array_distinct(F.array_compact(F.transform(F.array(ref, last(ref), stem(ref), F.col("name"), F.col("accession")), lambda k: F.lower(k))))).alias("key"))
    keys = keys.dropDuplicates(["key"])
    known = matches.select("reference").distinct()
    tried = known.select("reference", F.posexplode(F.array(F.lower(ref), F.lower(last(ref)), F.lower(stem(ref)))).alias("i", "key")).join(keys, "key")
    best = tried.withColumn("n", F.row_number().over(W.partitionBy("reference").orderBy("i"))).filter("n = 1")
    return matches.join(best.drop("i", "n", "key"), "reference", "left")


def pair_reads(files: DataFrame) -> DataFrame:
    """(sample_id, r1, r2) of file paths (column path): mates by _R1/_R2 or _1/_2; several lanes or a second file of a
    mate are an error, and a bare _1 without its mate keeps its whole stem as the sample."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.(?:fastq|fq)(?:\.gz)?)$", 1)
    mated = r"^(.*?)(?:_S\d+)?(?:_L(\d{3}))?_R?([12])(?:_\d{3})?$"
    rows = files.withColumn("name", name).withColumn("stem", F.when(F.col("name").rlike(mated), F.regexp_extract("name", mated, 1)).otherwise(F.col("name")))
    rows = rows.withColumn("mate", F.when(F.col("name").rlike(mated), F.regexp_extract("name", mated, 3)).otherwise("1"))
    out = rows.groupBy("stem").agg(
        F.count_if(F.col("mate") == "1").alias("n1"), F.count_if(F.col("mate") == "2").alias("n2"), F.max(F.when(F.col("mate") == "1", F.col("path"))).alias("r1"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("r2"), F.max("name").alias("name")
    )
    out = _checked(out, (F.col("n1") > 1) | (F.col("n2") > 1), "a sample has several files for one mate; merge its lanes first")
    alone = (F.col("n2") == 0) & ~F.col("name").rlike("_R1")
    return out.select(F.when(alone, F.col("name")).otherwise(F.col("stem")).alias("sample_id"), F.coalesce("r1", "r2").alias("r1"), F.when(F.col("r1").isNotNull(), F.col("r2")).alias("r2"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every source file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved JSON results; keys that the schema lacks are ignored."""
    return spark.read.schema(schema).json(path)


def number_rows(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with their place within ``by``."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))
