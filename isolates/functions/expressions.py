"""Column expressions shared by the operators: allele counts, severity, natural order, taxa and names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from isolates.functions.thresholds import CALL_SEVERITY, CONFIDENCE_ORDER, GRADE_CALL, RESISTANT_CALLS

BASES = ("A", "C", "G", "T")
COUNT = {b: f"n_{b.lower()}" for b in BASES} | {"N": "n_n", "-": "n_gap"}
#: Ties under the legacy convention, weakest first.
LEGACY_TIES = ("A", "C", "G", "T", "N", "-")


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as a double; NULL where d is zero or either is NULL."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))


def acgt_depth() -> Column:
    return sum((F.col(COUNT[b]) for b in BASES[1:]), F.col(COUNT["A"]))


def depth(convention: str = "acgt") -> Column:
    """Reads that count at a site: the four bases, or with N and gaps under the legacy convention."""
    if convention == "acgt":
        return acgt_depth()
    if convention == "legacy":
        return acgt_depth() + F.coalesce("n_n", F.lit(0)) + F.coalesce("n_gap", F.lit(0))
    raise ValueError(f"convention is acgt or legacy; got {convention!r}")


def pool(convention: str) -> tuple[str, ...]:
    return BASES if convention == "acgt" else LEGACY_TIES


def highest_count(convention: str = "acgt") -> Column:
    return F.greatest(*[F.coalesce(COUNT[b], F.lit(0)) for b in pool(convention)])


def is_tied() -> Column:
    """Whether two of the four bases share the highest count."""
    top = highest_count()
    return sum((F.when(F.col(COUNT[b]) == top, 1).otherwise(0) for b in BASES[1:]), F.when(F.col("n_a") == top, 1).otherwise(0)) > 1


def major_allele(convention: str = "acgt") -> Column:
    """The best supported allele: NULL without reads; a tie is NULL, or the last of A, C, G, T, N, gap under legacy."""
    top = highest_count(convention)
    chain = F.when(top == 0, None)
    if convention == "acgt":
        chain = chain.when(is_tied(), None)
    for b in reversed(pool(convention)):
        chain = chain.when(F.coalesce(COUNT[b], F.lit(0)) == top, b)
    return chain


def count_of(allele: Column) -> Column:
    """Reads with an allele given as a column."""
    chain = F.when(allele == "A", F.col("n_a"))
    for b in ("C", "G", "T"):
        chain = chain.when(allele == b, F.col(COUNT[b]))
    return F.when(allele.isNotNull(), chain.otherwise(F.lit(0)))


def base_counts() -> Column:
    """The four bases as structs, commonest first, then by letter."""
    return F.transform(
        F.array_sort(F.array(*[F.struct((-F.col(COUNT[b])).alias("k"), F.lit(b).alias("base"), F.col(COUNT[b]).alias("n")) for b in BASES])),
        lambda x: F.struct(x["base"].alias("base"), x["n"].alias("n")),
    )


def ranked(values: Iterable[str], column: Column) -> Column:
    """Place of a value in an order; NULL for others."""
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, v in enumerate(values):
        chain = chain.when(column == v, F.lit(i))
    return chain


def severity(call: Column) -> Column:
    return ranked([c for c, _ in sorted(CALL_SEVERITY.items(), key=lambda x: x[1])], call)


def is_resistant(call: Column) -> Column:
    return call.isin(*RESISTANT_CALLS)


def call_for_grade(grade: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for g, call in GRADE_CALL.items():
        chain = chain.when(grade == g, F.lit(call))
    return chain


def downgrade(confidence: Column, steps: Column) -> Column:
    """``steps`` less confident, never below the last."""
    order = F.array(*[F.lit(c) for c in CONFIDENCE_ORDER])
    at = F.coalesce(ranked(CONFIDENCE_ORDER, confidence), F.lit(len(CONFIDENCE_ORDER) - 1))
    return F.element_at(order, F.least(at + F.greatest(steps, F.lit(0)), F.lit(len(CONFIDENCE_ORDER) - 1)) + 1)


def natural_key(text: Column) -> Column:
    """A string that sorts as the text does with its digit runs as numbers, numbers after letters."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    # longer numbers are larger ones: the number of digits stands first
    pad = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("~"), F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))).otherwise(p))
    return F.array_join(pad, "")


HIERARCHICAL = r"^(lineage|La)[0-9]+(\.[A-Za-z0-9_-]+)*$"


def taxon_components(taxon: Column) -> Column:
    return F.when(taxon.rlike(HIERARCHICAL), F.split(taxon, r"\.")).otherwise(F.array(F.coalesce(taxon, F.lit(""))))


def taxon_depth(taxon: Column) -> Column:
    return F.size(taxon_components(taxon))


def taxon_root(taxon: Column) -> Column:
    return F.element_at(taxon_components(taxon), 1)


def taxon_ancestors(taxon: Column) -> Column:
    """All ancestors, shallowest first, without the taxon itself."""
    parts = taxon_components(taxon)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(
        F.array().cast("array<string>")
    )


def passes(filters: Column) -> Column:
    """Whether every filter of a variant is empty, PASS or a point."""
    return F.forall(F.coalesce(filters, F.array().cast("array<string>")), lambda f: F.upper(F.trim(f)).isin("", "PASS", "."))


def variant_type(ref: Column, alt: Column) -> Column:
    """snp, mnv, insertion, deletion or indel."""
    same = F.length(ref) == F.length(alt)
    return (
        F.when(same & (F.length(ref) == 1), "snp")
        .when(same, "mnv")
        .when((F.length(alt) > F.length(ref)) & F.startswith(alt, ref), "insertion")
        .when((F.length(ref) > F.length(alt)) & F.startswith(ref, alt), "deletion")
        .otherwise("indel")
    )


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """Position and alleles without a shared end, then without a shared beginning, one base each kept."""
    shortest = F.least(F.length(ref), F.length(alt)) - 1

    def shared(a: Column, b: Column, most: Column) -> Column:
        """Characters that two texts begin with alike, ``most`` at most."""
        steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n))

    tail = shared(F.reverse(ref), F.reverse(alt), shortest)
    r, a = F.substr(ref, F.lit(1), F.length(ref) - tail), F.substr(alt, F.lit(1), F.length(alt) - tail)
    head = shared(r, a, F.least(F.length(r), F.length(a)) - 1)
    return F.struct((pos + head).alias("pos"), F.substr(r, head + 1).alias("ref"), F.substr(a, head + 1).alias("alt"))


def coordinate_key(chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt") -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(pos).cast("string"), F.col(ref), F.lit(">"), F.col(alt))


def parse_coordinate(text: Column) -> Column:
    """The struct that :func:`coordinate_key` was made of, NULL if the text is none."""
    pattern = r"^(.+):(\d+)([A-Za-z]+)>([A-Za-z]+)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("chrom"), part(2).cast("int").alias("pos"), part(3).alias("ref"), part(4).alias("alt")))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


# The standard genetic code in the order of the bases T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_acid(codon: Column) -> Column:
    """One-letter residue of a codon, * for a stop, X for one that is not of four bases."""
    at = lambda i: F.instr(F.lit("TCAG"), F.substr(F.upper(codon), F.lit(i), F.lit(1)))
    index = (at(1) - 1) * 16 + (at(2) - 1) * 4 + at(3)
    known = F.upper(codon).rlike("^[ACGT]{3}$")
    return F.when(known, F.substr(F.lit(AMINO_ACIDS), index, F.lit(1))).when(codon.isNotNull(), "X")


def translate(sequence: Column) -> Column:
    """Residues of a coding sequence; a codon that is cut off at the end is left out."""
    # one pass over the text: taking each codon by its place would walk from the start every time
    codons = F.regexp_extract_all(sequence, F.lit("(?s)(.{3})"), 1)
    return F.array_join(F.transform(codons, amino_acid), "")


# Three-letter names of the residues.
THREE = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "*": "Ter",
}


def three_letter(residue: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])[residue], F.when(residue.isNotNull(), "Xaa"))
