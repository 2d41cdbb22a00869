"""Drug names and codes, platform names, grades as text, and what a catalogue comment says about a drug."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drugs and their codes.
CODES = {
    "rifampicin": "RIF", "isoniazid": "INH", "ethambutol": "EMB", "pyrazinamide": "PZA", "levofloxacin": "LFX",
    "moxifloxacin": "MFX", "bedaquiline": "BDQ", "linezolid": "LZD", "clofazimine": "CFZ", "delamanid": "DLM",
    "pretomanid": "PMD", "amikacin": "AMK", "kanamycin": "KAN", "streptomycin": "STM", "ethionamide": "ETO",
    "capreomycin": "CAP", "clarithromycin": "CLR", "para-aminosalicylic acid": "PAS", "cycloserine": "CS",
}
# Other spellings of each drug, in lower case.
SPELLINGS = {
    "rifampicin": ("rifampin", "rmp"),
    "isoniazid": ("isoniazide",),
    "levofloxacin": ("levofloxacine", "lev", "lvx"),
    "moxifloxacin": ("moxifloxacine", "mxf"),
    "pretomanid": ("pa",),
    "kanamycin": ("km",),
    "streptomycin": ("streptomycine", "str", "sm"),
    "ethionamide": ("ethionamid", "eth"),
    "clarithromycin": ("clarithromycine",),
    "para-aminosalicylic acid": ("para aminosalicylic acid", "p-aminosalicylic acid", "aminosalicylic acid"),
    "cycloserine": ("d-cycloserine", "dcs", "terizidone"),
}
# Platform names that users write.
PLATFORM_NAMES = {
    "illumina": ("illumina", "ilm", "short", "pe", "paired"),
    "ont": ("ont", "nanopore", "long", "minion"),
    "fasta": ("fasta", "assembly", "contigs", "genome"),
}
# Phrases of comments, in the order in which they count, and the level that each states.
LEVELS = (("additive", "additive low-level"), ("high-level resistance", "high-level"), ("low-level resistance", "low-level"))
CROSS_CUES = ("cross-resistance", "cross resistance", "crossresistance", "cross-resistant", "cross resistant")
CROSS_PAIRS = (("delamanid", "pretomanid"), ("bedaquiline", "clofazimine"))
#: What a platform means for a drug call: for each caveat its code and its wording.
CAVEATS = {
    "ont-indel": "rests on an indel, which long reads call less surely",
    "ont-minor": "long reads miss minor variants: none seen does not mean none there",
    "assembly": "an assembly has no allele fractions: mixtures and minor variants cannot be seen",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _clean(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def drug_name(text: Column) -> Column:
    """The drug that a name, code or other spelling means, in lower case; an unknown one stays, a blank one is NULL."""
    known = {d: d for d in CODES} | {c.lower(): d for d, c in CODES.items()} | {s: d for d, others in SPELLINGS.items() for s in others}
    return F.nullif(F.coalesce(_lookup(known, _clean(text)), _clean(text)), F.lit(""))


def drug_code(text: Column) -> Column:
    """The code of a drug; the first three letters of one that has none."""
    name = drug_name(text)
    return F.coalesce(_lookup(CODES, name), F.upper(F.substr(name, F.lit(1), F.lit(3))))


def platform_name(text: Column) -> Column:
    """The platform that a name means, NULL for an unknown one."""
    return _lookup({other: name for name, others in PLATFORM_NAMES.items() for other in others}, _clean(text))


# The five grades as they are written.
GRADES = ("1) Assoc w R", "2) Assoc w R - Interim", "3) Uncertain significance", "4) Not assoc w R - Interim", "5) Not assoc w R")


def grade_number(text: Column) -> Column:
    """1 to 5 of a grade as text: ``2``, ``group 2`` or its written form with any dash; NULL for anything else, which is no grade."""
    key = F.regexp_replace(_clean(text), " [\u2013\u2014] ", " - ")
    known = {form: str(i) for i, g in enumerate(GRADES, 1) for form in (g.lower(), str(i), f"group {i}")}
    return _lookup(known, key).cast("int")


def level_stated(comment: Column) -> Column:
    """The level of resistance that a comment states, NULL where it states none."""
    text, out = _clean(comment), F.lit(None).cast("string")
    for phrase, level in reversed(LEVELS):
        out = F.when(text.contains(phrase), level).otherwise(out)
    return out


def drugs_named(comment: Column) -> Column:
    """The drugs that a comment names as whole words, by name or code, in the order of their names."""
    text = F.coalesce(comment, F.lit(""))
    hits = [F.when(text.rlike(rf"(?i)\b(?:{name}|{code})\b"), name) for name, code in sorted(CODES.items())]
    return F.array_compact(F.array(*hits))


def cross_resistance(comment: Column, drug: Column) -> Column:
    """The other drugs that a comment says a change also acts on: those it names, else the drug's documented partner.

    Without a word of cross-resistance the list is empty: comments name drugs for other reasons too.
    """
    text, own = _clean(comment), drug_name(drug)
    cued = F.lit(False)
    for cue in CROSS_CUES:
        cued = cued | text.contains(cue)
    partner = _lookup({a: b for pair in CROSS_PAIRS for a, b in (pair, pair[::-1])}, own)
    named = F.filter(drugs_named(comment), lambda d: ~d.eqNullSafe(own))
    return F.when(cued, F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(partner)))).otherwise(F.array().cast("array<string>"))


def caveats(platform: str, resistant: Column, indel: Column, minor: Column) -> Column:
    """Codes of ``CAVEATS`` for a drug call, each once and in a fixed order.

    ``indel`` and ``minor``: whether any counted variant is one. Long reads also leave a call that is not resistant in doubt.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    if platform == "ont":
        listed = [F.when(true(indel), "ont-indel"), F.when(true(minor) | ~true(resistant), "ont-minor")]
    else:
        listed = [F.lit("assembly")] if platform == "fasta" else []
    return F.array_distinct(F.array_compact(F.array(*listed).cast("array<string>")))
