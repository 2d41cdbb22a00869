"""Names of variants: canonical forms, keys, aliases and what a protein change says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isolates.functions.expressions import THREE

# Legacy codon and base numberings (gene, kind, offset, first, last of the new numbering).
OFFSETS = (("rpoB", "p", 81, 400, 510), ("rrs", "n", 7, 1350, 1537))
# The resistance region of rpoB, its borderline changes, and genes whose loss means resistance.
RRDR = (426, 452)
BORDERLINE = ("p.Leu430Pro", "p.His445Asn", "p.His445Ser", "p.Ile491Phe")
LOSS_GENES = {
    "isoniazid": ("katG",),
    "pyrazinamide": ("pncA",),
    "bedaquiline": ("Rv0678", "pepQ"),
    "clofazimine": ("Rv0678", "pepQ"),
    "delamanid": ("ddn", "fbiA", "fbiB", "fbiC", "fbiD", "fgd1"),
    "pretomanid": ("ddn", "fbiA", "fbiB", "fbiC", "fbiD", "fgd1"),
    "ethionamide": ("ethA",),
}
RRDR_DRUG = "rifampicin"

_ONE = {v: k for k, v in THREE.items()}


def _mapped(text: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[text]


def normalise(hgvs: Column) -> Column:
    """A name with its prefix, three-letter residues and upper-case bases; names of rules (LoF, words) stay as they are."""
    t = F.trim(hgvs)
    one = r"^(?:p\.)?([A-Z*])(\d+)([A-Z*])$"
    part = lambda i: F.regexp_extract(t, one, i)
    named = F.concat(F.lit("p."), _mapped(part(1), THREE), part(2), F.when(part(3) == "*", "Ter").otherwise(_mapped(part(3), THREE)))
    three = r"^(?:p\.)?([A-Z][a-z]{2}\d+.*)$"
    coding = r"^(?:([cn])\.)?([-*]?\d+(?:_[-*]?\d+)?)(.*)$"
    bases = F.concat(F.coalesce(F.nullif(F.regexp_extract(t, coding, 1), F.lit("")), F.lit("c")), F.lit("."), F.regexp_extract(t, coding, 2), _upper_bases(F.regexp_extract(t, coding, 3)))
    return F.when(t.rlike(one) & named.isNotNull(), named).when(t.rlike(three), F.concat(F.lit("p."), F.regexp_replace(F.regexp_extract(t, three, 1), r"\*", "Ter"))).when(t.rlike(coding), bases).otherwise(t)


def _upper_bases(change: Column) -> Column:
    """``a>g`` or ``delacg`` with bases in upper case."""
    word = F.regexp_extract(change, r"^(delins|del|dup|ins|inv)?(.*)$", 1)
    return F.concat(word, F.upper(F.regexp_extract(change, r"^(delins|del|dup|ins|inv)?(.*)$", 2)))


def hgvs_key(gene: Column, hgvs: Column) -> Column:
    """``gene_name``, NULL where either is missing."""
    return F.when((gene != "") & (hgvs != ""), F.concat(gene, F.lit("_"), normalise(hgvs)))


def split_key(key: Column) -> Column:
    """The struct (gene, hgvs) of a key, parted before its name's prefix or at the last underscore."""
    prefixed = r"^(.+)_([pcn]\..+)$"
    gene = F.when(key.rlike(prefixed), F.regexp_extract(key, prefixed, 1)).otherwise(F.regexp_extract(key, r"^(.*)_([^_]+)$", 1))
    name = F.when(key.rlike(prefixed), F.regexp_extract(key, prefixed, 2)).otherwise(F.regexp_extract(key, r"^(.*)_([^_]+)$", 2))
    return F.when(key.contains("_"), F.struct(gene.alias("gene"), name.alias("hgvs")))


def one_letter(hgvs: Column) -> Column:
    """The protein change with one-letter residues, NULL if it is not a plain substitution."""
    pattern = r"^p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})$"
    a, b = (_mapped(F.regexp_extract(hgvs, pattern, i), _ONE) for i in (1, 3))
    return F.when(hgvs.rlike(pattern), F.concat(F.lit("p."), a, F.regexp_extract(hgvs, pattern, 2), b))


def renumbered(gene: Column, hgvs: Column) -> Column:
    """The name in the legacy numbering of its gene, NULL where there is none or the place lies outside it."""
    out = F.lit(None).cast("string")
    for name, kind, offset, low, high in OFFSETS:
        pattern = rf"^({kind}\.\D*?)(\d+)(.*)$"
        at = F.regexp_extract(hgvs, pattern, 2).try_cast("int")
        new = F.concat(F.regexp_extract(hgvs, pattern, 1), (at + offset).cast("string"), F.regexp_extract(hgvs, pattern, 3))
        out = F.when((gene == name) & at.between(low, high), new).otherwise(out)
    return out


def alias_keys(gene: Column, hgvs: Column, canonical: bool = False) -> Column:
    """Keys of a name's other spellings: one-letter residues and the legacy numbering. ``canonical``: it is normalised already."""
    name = hgvs if canonical else normalise(hgvs)
    legacy = renumbered(gene, name)
    others = F.array_distinct(F.array_compact(F.array(one_letter(name), legacy, one_letter(legacy))))
    return F.coalesce(F.transform(others, lambda x: F.concat(gene, F.lit("_"), x)), F.array().cast("array<string>"))


def difference_kind(gene: Column, a: Column, b: Column) -> Column:
    """none for one name, nomenclature for two spellings of it, else biological."""
    ka, kb = hgvs_key(gene, a), hgvs_key(gene, b)
    spelled = F.array_contains(alias_keys(gene, a), kb) | F.array_contains(alias_keys(gene, b), ka) | F.arrays_overlap(alias_keys(gene, a), alias_keys(gene, b))
    return F.when(ka == kb, "none").when(spelled, "nomenclature").otherwise("biological")


def protein_change(hgvs: Column) -> Column:
    """(ref, codon, alt) of a protein name, NULL for others; alt is fs, del and the like for what is no substitution."""
    pattern = r"^p\.([A-Z][a-z]{2})(\d+)(.*)$"
    return F.when(
        hgvs.rlike(pattern),
        F.struct(F.regexp_extract(hgvs, pattern, 1).alias("ref"), F.regexp_extract(hgvs, pattern, 2).cast("int").alias("codon"), F.regexp_extract(hgvs, pattern, 3).alias("alt")),
    )


def nucleotide_position(hgvs: Column) -> Column:
    """The first position of a c. or n. name, negative upstream."""
    return F.regexp_extract(hgvs, r"^[cn]\.(-?\d+)", 1).try_cast("int")


def codon(hgvs: Column) -> Column:
    """The codon that a protein name states or a coding position lies in."""
    at = nucleotide_position(hgvs)
    return F.coalesce(protein_change(hgvs)["codon"], F.when(hgvs.startswith("c.") & (at > 0), F.ceil(at / 3).cast("int")))


def is_promoter(hgvs: Column) -> Column:
    return F.coalesce(hgvs.rlike(r"^[cn]\.-\d"), F.lit(False))


def is_synonymous(hgvs: Column) -> Column:
    change = protein_change(hgvs)
    return F.coalesce((change["alt"] == "=") | (change["alt"] == change["ref"]), F.lit(False))


def is_loss_of_function(hgvs: Column, effect: Column) -> Column:
    """Frameshift, stop gained, start lost or gene deleted, by name or by effect."""
    by_name = hgvs.rlike(r"fs|^p\.[A-Z][a-z]{2}\d+(Ter|\*)|^p\.Met1(\?|[A-Z])|^LoF$")
    by_effect = F.lower(effect).rlike("frameshift|stop_gained|start_lost|feature_ablation|transcript_ablation")
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_effect, F.lit(False))


def in_rrdr(gene: Column, hgvs: Column) -> Column:
    return F.coalesce((gene == "rpoB") & protein_change(hgvs)["codon"].between(*RRDR), F.lit(False))


def is_borderline(gene: Column, hgvs: Column) -> Column:
    return F.coalesce((gene == "rpoB") & normalise(hgvs).isin(*BORDERLINE), F.lit(False))
