"""Gene context and names of variants: genes and promoters at a position, and HGVS names of substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE
from isolates.operators.intervals import BIN

# Biotypes without a reading frame.
NON_CODING = ("rrna", "trna", "ncrna", "misc_rna", "tmrna", "rrna_gene", "trna_gene")


def coding_offset(pos: Column) -> Column:
    """The position in the gene's own direction: 1 is its first base, -1 the base before; there is no 0."""
    forward = F.when(pos >= F.col("start_pos"), pos - F.col("start_pos") + 1).otherwise(pos - F.col("start_pos"))
    back = F.when(pos <= F.col("end_pos"), F.col("end_pos") - pos + 1).otherwise(F.col("end_pos") - pos)
    return F.when(F.col("strand") == "+", forward).otherwise(back)


def gene_spans(genes: DataFrame, upstream: int = int(VALUE["promoter_window"])) -> DataFrame:
    """``genes`` (1-based, inclusive) with the span that their promoter adds, once for each bin that it touches."""
    low = F.when(F.col("strand") == "+", F.col("start_pos") - upstream).otherwise(F.col("start_pos"))
    high = F.when(F.col("strand") == "+", F.col("end_pos")).otherwise(F.col("end_pos") + upstream)
    spans = genes.withColumns({"low": F.greatest(low, F.lit(1)), "high": high})
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor(F.col("high") / BIN))))


def gene_context(variants: DataFrame, genes: DataFrame, upstream: int = int(VALUE["promoter_window"])) -> DataFrame:
    """``variants`` with the gene that names them, NULL between genes.

    Inside several genes the shortest is meant; outside all, the promoter with the nearest start. Ties go by name.
    ``genes``: name, chrom, start_pos, end_pos, strand and optionally biotype.
    """
    if "biotype" not in genes.columns:
        genes = genes.withColumn("biotype", F.lit("protein_coding"))
    spans = gene_spans(genes.select("name", "chrom", "start_pos", "end_pos", "strand", "biotype"), upstream)
    keys = ["sample_id", "variant_id"]
    at = variants.select(*keys, "chrom", "pos").withColumn("bin", F.floor(F.col("pos") / BIN))
    met = at.join(spans, ["chrom", "bin"]).filter(F.col("pos").between(F.col("low"), F.col("high")))
    within = F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    met = met.withColumn("offset", coding_offset(F.col("pos")))
    rank = F.when(within, F.struct(F.lit(0).alias("o"), (F.col("end_pos") - F.col("start_pos")).alias("d"), F.col("name"))).otherwise(F.struct(F.lit(1).alias("o"), F.abs("offset").alias("d"), F.col("name")))
    best = met.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(rank))).filter("i = 1")
    return variants.join(best.select(*keys, F.col("name").alias("gene"), "start_pos", "end_pos", "strand", "biotype", "offset"), keys, "left")


def _oriented(bases: Column) -> Column:
    return F.when(F.col("strand") == "-", E.reverse_complement(bases)).otherwise(bases)


def name_substitutions(context: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """``context`` (with the gene of each row) with ``hgvs`` and ``effect`` for single-base substitutions.

    Upstream and non-coding changes get nucleotide names; inside a reading frame the codon decides between synonymous,
    start_lost, stop_gained and missense. Without a sequence the nucleotide name stands. ``sequences``: chrom, seq.
    """
    coding = ~F.lower("biotype").isin(*NON_CODING)
    prefix = F.when(coding, "c.").otherwise("n.")
    c = F.col("offset")
    plain = F.concat(prefix, c.cast("string"), _oriented(F.col("ref")), F.lit(">"), _oriented(F.col("alt")))
    number = F.floor((c - 1) / 3).cast("int") + 1
    first = F.when(F.col("strand") == "+", F.col("start_pos") + (number - 1) * 3).otherwise(F.col("end_pos") - number * 3 + 1)
    out = context
    if sequences is None:
        out = out.withColumn("codon", F.lit(None).cast("string"))
    else:
        out = out.join(sequences.select("chrom", "seq"), "chrom", "left")
        out = out.withColumn("codon", F.when((c > 0) & coding, F.upper(_oriented(F.substr("seq", first.cast("int"), F.lit(3)))))).drop("seq")
    place = F.pmod(c - 1, F.lit(3)).cast("int")
    mutant = F.concat(F.substr("codon", F.lit(1), place), _oriented(F.col("alt")), F.substr("codon", place + 2))
    out = out.withColumn("mutant", F.when(F.length("codon") == 3, mutant))
    before, after = E.amino_acid(F.col("codon")), E.amino_acid(F.col("mutant"))
    protein = F.concat(F.lit("p."), E.three_letter(before), number.cast("string"), E.three_letter(after))
    effect = (
        F.when(F.col("gene").isNull(), "intergenic_variant")
        .when(c < 0, "upstream_variant")
        .when(~coding, "non_coding_variant")
        .when(F.col("mutant").isNull(), "coding_variant")
        .when(number == 1, "start_lost")
        .when(before == after, "synonymous_variant")
        .when(after == "*", "stop_gained")
        .otherwise("missense_variant")
    )
    out = out.withColumn("effect", effect)
    name = F.when(F.col("gene").isNull(), None).when(F.col("effect").isin("missense_variant", "stop_gained"), protein).otherwise(plain)
    return out.withColumn("hgvs", name).drop("codon", "mutant")


def name_blocks(context: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows of several substituted bases, each named by the whole codon that its first changed base lies in.

    Returns sample_id, variant_id, gene, hgvs, effect. The codon is rebuilt with every base of the row that it holds.
    """
    base = context.filter((F.length("ref") == F.length("alt")) & (F.length("ref") > 1) & F.col("gene").isNotNull())
    each = base.select("*", F.posexplode(F.split("ref", "")).alias("i", "r")).withColumn("a", F.substr("alt", F.col("i") + 1, F.lit(1))).filter("r <> '' and r <> a")
    each = each.withColumn("at", F.col("pos") + F.col("i"))
    each = each.withColumn("c", coding_offset(F.col("at"))).filter("c > 0").withColumn("number", F.floor((F.col("c") - 1) / 3).cast("int") + 1)
    first = F.min_by("number", "at").over(W.partitionBy("sample_id", "variant_id"))
    each = each.withColumn("wanted", first).filter("number = wanted").join(sequences.select("chrom", "seq"), "chrom")
    low = F.when(F.col("strand") == "+", F.col("start_pos") + (F.col("number") - 1) * 3).otherwise(F.col("end_pos") - F.col("number") * 3 + 1).cast("int")
    rows = each.groupBy("sample_id", "variant_id", "gene", "number", "strand", low.alias("low")).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "a"))).alias("new"), F.first(F.upper(F.substr("seq", low, F.lit(3)))).alias("codon")
    )
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.col("new")[F.col("low") + i], F.substr("codon", i + 1, F.lit(1)))), "")
    rows = rows.withColumn("before", E.amino_acid(_oriented(F.col("codon")))).withColumn("after", E.amino_acid(_oriented(changed)))
    effect = F.when(F.col("before") == F.col("after"), "synonymous_variant").when(F.col("number") == 1, "start_lost").when(F.col("after") == "*", "stop_gained").otherwise("missense_variant")
    name = F.concat(F.lit("p."), E.three_letter(F.col("before")), F.col("number").cast("string"), E.three_letter(F.col("after")))
    return rows.select("sample_id", "variant_id", "gene", name.alias("hgvs"), effect.alias("effect"))


def genes_lost(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample_id, variant_id, gene) for deletions that take away a gene's whole span."""
    lost = variants.filter(F.length("ref") > F.length("alt")).withColumns({"gone_from": F.col("pos") + F.length("alt"), "gone_to": F.col("pos") + F.length("ref") - 1})
    lost = lost.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gone_from") / BIN), F.floor(F.col("gone_to") / BIN))))
    starts = genes.select(F.col("name").alias("gene"), "chrom", "start_pos", "end_pos", F.floor(F.col("start_pos") / BIN).alias("bin"))
    met = lost.join(starts, ["chrom", "bin"]).filter((F.col("start_pos") >= F.col("gone_from")) & (F.col("end_pos") <= F.col("gone_to")))
    return met.select("sample_id", "variant_id", "gene")


def left_align(variants: DataFrame, sequences: DataFrame, window: int = 200) -> DataFrame:
    """``variants`` with indels at their leftmost place within ``window`` bases, and ``aligned``: NULL for other rows.

    A pure insertion or deletion moves left while the base before it equals its last base. A row that moved through the
    whole window may move further: its ``aligned`` is false, as is that of one without a sequence. On tiles,
    :func:`isolates.operators.annotation.left_aligned_alleles` aligns without a window.
    """
    trim = E.trimmed(F.col("pos"), F.upper("ref"), F.upper("alt"))
    rows = variants.withColumn("__t", trim).join(sequences.select("chrom", "seq"), "chrom", "left")
    indel = (F.length("__t.ref") != F.length("__t.alt")) & (F.least(F.length("__t.ref"), F.length("__t.alt")) == 1)
    pos, ref, alt = F.col("__t.pos"), F.col("__t.ref"), F.col("__t.alt")
    moved = F.substr(F.when(F.length(ref) > F.length(alt), ref).otherwise(alt), F.lit(2))  # bases put in or taken out
    n = F.length(moved)
    before = F.upper(F.substr("seq", F.greatest(pos - window + 1, F.lit(1)), F.least(pos, F.lit(window))))
    text = F.reverse(F.concat(before, moved))  # going left, each base must equal the one n places to its right
    steps = F.aggregate(
        F.sequence(F.lit(1), F.length(before)), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.substr(text, i, F.lit(1)) == F.substr(text, i + n, F.lit(1))), i).otherwise(k),
    )
    steps = F.least(steps, pos - 1)
    rows = rows.withColumn("__k", F.when(indel & F.col("seq").isNotNull(), steps).otherwise(0))
    k = F.col("__k")
    anchor = F.upper(F.substr("seq", pos - k, F.lit(1)))
    block = F.upper(F.substr(F.concat(before, moved), F.length(before) - k + 1, n))
    longer = F.concat(anchor, block)
    deleted = F.length(ref) > F.length(alt)
    out = rows.withColumns(
        {
            "pos": (pos - k).cast("int"),
            "ref": F.when(k > 0, F.when(deleted, longer).otherwise(anchor)).otherwise(ref),
            "alt": F.when(k > 0, F.when(deleted, anchor).otherwise(longer)).otherwise(alt),
            "aligned": F.when(indel, F.coalesce((k < F.least(pos, F.lit(window))) | (pos - k <= 1), F.lit(False)) & F.col("seq").isNotNull()),
        }
    )
    return out.drop("__t", "__k", "seq")


def name_indels(context: DataFrame) -> DataFrame:
    """``context`` rows of insertions and deletions with ``hgvs`` and ``effect``, in the gene's own direction.

    The first base of both alleles is the anchor. Names carry their bases, insertions the bases that flank them. A
    deletion that runs from upstream into the gene loses its start; a shift that is no multiple of three is a
    frameshift, named by the first codon that it touches.
    """
    rows = context.filter((F.length("ref") != F.length("alt")) & F.col("gene").isNotNull())
    coding = ~F.lower("biotype").isin(*NON_CODING)
    prefix = F.when(coding, "c.").otherwise("n.")
    size = F.abs(F.length("alt") - F.length("ref"))
    first, last = coding_offset(F.col("pos") + 1), coding_offset(F.col("pos") + size)
    low, high = F.least(first, last), F.greatest(first, last)
    span = F.when(size == 1, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("_"), high.cast("string")))
    gone = F.concat(prefix, span, F.lit("del"), _oriented(F.substr("ref", F.lit(2), size)))
    anchor = F.col("offset")
    forward = F.col("strand") == "+"
    left = F.when(forward, anchor).otherwise(anchor - 1)
    new = F.concat(prefix, left.cast("string"), F.lit("_"), (left + 1).cast("string"), F.lit("ins"), _oriented(F.substr("alt", F.lit(2), size)))
    touched = F.when(forward, anchor + 1).otherwise(anchor)
    deleted = F.length("alt") < F.length("ref")
    shifted = size % 3 != 0
    shift_name = F.concat(F.lit("p.Xaa"), (F.floor((F.when(deleted, low).otherwise(touched) - 1) / 3) + 1).cast("string"), F.lit("fs"))
    effect = (
        F.when(~coding, "non_coding_variant")
        .when(F.when(deleted, high).otherwise(touched) < 1, "upstream_variant")
        .when(deleted & (low < 1), "start_lost")
        .when(shifted, "frameshift_variant")
        .when(deleted, "inframe_deletion")
        .otherwise("inframe_insertion")
    )
    out = rows.withColumn("effect", effect)
    return out.withColumn("hgvs", F.when(F.col("effect") == "frameshift_variant", shift_name).when(deleted, gone).otherwise(new))


def frameshift_codons(indels: DataFrame, sequences: DataFrame) -> DataFrame:
    """(sample_id, variant_id, hgvs): frameshifts named by the first residue that really changes.

    The gene's coding sequence is cut out, changed and translated in both forms; the first residue that differs names
    it. In-frame changes that shorten the product count as frameshifts; rows whose reference does not fit are left out.
    """
    rows = indels.join(sequences.select("chrom", "seq"), "chrom").filter(~F.lower("biotype").isin(*NON_CODING))
    rows = rows.withColumn("cds", F.upper(F.substr("seq", F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1))).withColumn("at", F.col("pos") - F.col("start_pos"))
    rows = rows.filter((F.col("at") >= 0) & (F.substr("cds", F.col("at") + 1, F.length("ref")) == F.upper("ref")))
    changed = F.concat(F.substr("cds", F.lit(1), F.col("at")), F.upper("alt"), F.substr("cds", F.col("at") + 1 + F.length("ref")))
    to_stop = lambda p: F.regexp_extract(p, r"^[^*]*\*?", 0)
    rows = rows.withColumns({"old": to_stop(E.translate(_oriented(F.col("cds")))), "new": to_stop(E.translate(_oriented(changed)))})
    rows = rows.filter((F.abs(F.length("alt") - F.length("ref")) % 3 != 0) | (F.length("new") < F.length("old")))
    most = F.least(F.length("old"), F.length("new"))
    same = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr("old", i, F.lit(1)) == F.substr("new", i, F.lit(1))), i).otherwise(n))).otherwise(0)
    rows = rows.withColumn("same", same).filter(F.col("same") < F.length("old"))
    residue = E.three_letter(F.substr("old", F.col("same") + 1, F.lit(1)))
    return rows.select("sample_id", "variant_id", F.concat(F.lit("p."), residue, (F.col("same") + 1).cast("string"), F.lit("fs")).alias("hgvs"))


def equivalent_placements(variants: DataFrame, sequences: DataFrame, window: int = 24) -> DataFrame:
    """(sample_id, variant_id, pos, ref, alt): every placement of an insertion or deletion that gives the same sequence.

    The block that is put in or taken out moves by a base while the base that it leaves equals the one that it takes in,
    up to ``window`` bases to each side. Other rows, rows without a sequence and rows whose reference does not fit keep
    their own placement only. ``sequences``: chrom, seq.
    """
    trim = E.trimmed(F.col("pos"), F.upper("ref"), F.upper("alt"))
    rows = variants.select("sample_id", "variant_id", "chrom", trim.alias("t")).select("sample_id", "variant_id", "chrom", "t.*")
    rows = rows.join(sequences.select("chrom", "seq"), "chrom", "left")
    longer = F.when(F.length("ref") > F.length("alt"), F.col("ref")).otherwise(F.col("alt"))
    n = F.length(longer) - 1
    deleted = F.length("ref") > F.length("alt")
    begin = F.greatest(F.col("pos") - window + 1, F.lit(1)).cast("int")
    left = F.upper(F.substr("seq", begin, F.col("pos") - begin + 1))
    right = F.upper(F.substr("seq", F.col("pos") + F.length("ref"), F.lit(window)))
    fits = (F.least(F.length("ref"), F.length("alt")) == 1) & (n > 0) & (F.upper(F.substr("seq", F.col("pos"), F.length("ref"))) == F.col("ref"))
    rows = rows.withColumns({"n": n, "deleted": deleted, "fits": F.coalesce(fits, F.lit(False)), "text": F.concat(left, F.substr(longer, F.lit(2)), right), "at": F.length(left) + 1, "right": F.length(right)})
    letter = lambda i: F.substr("text", i, F.lit(1))

    def steps(most: Column, same) -> Column:
        seq = F.when(F.col("fits") & (most > 0), F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(seq, F.lit(0), lambda k, i: F.when((k == i - 1) & same(i), i).otherwise(k))

    at, n = F.col("at"), F.col("n")
    back = steps(F.col("at") - 2, lambda i: letter(at - i) == letter(at - i + n))
    on = steps(F.col("right"), lambda i: letter(at + i - 1) == letter(at + i - 1 + n))
    placed = rows.withColumns({"back": back, "on": on}).withColumn("s", F.explode(F.sequence(-F.col("back"), F.col("on"))))
    anchor, block = letter(at + F.col("s") - 1), F.substr("text", at + F.col("s") - 1, n + 1)
    shown = lambda own, new: F.when(F.col("fits"), new).otherwise(F.col(own))
    return placed.select(
        "sample_id", "variant_id", (F.col("pos") + F.col("s")).cast("int").alias("pos"),
        shown("ref", F.when(F.col("deleted"), block).otherwise(anchor)).alias("ref"), shown("alt", F.when(F.col("deleted"), anchor).otherwise(block)).alias("alt"),
    )
