"""Thresholds of the analysis, as a table and as plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Threshold:
    name: str
    value: float
    unit: str
    source: str
    verified: bool = True


# Thresholds that results must agree with.
ALL = (
    Threshold("min_reads_illumina", 3, "reads", "clinical DST practice"),
    Threshold("min_reads_ont", 5, "reads", "clinical DST practice"),
    Threshold("min_reads_fasta", 1, "observations", "a consensus base is one observation"),
    Threshold("major_variant_fraction", 0.90, "fraction", "clinical DST practice"),
    Threshold("min_minor_fraction", 0.05, "fraction", "policy", False),
    Threshold("depth_illumina", 25, "reads", "policy", False),
    Threshold("callable_depth", 10, "reads", "policy", False),
    Threshold("min_breadth", 0.95, "fraction", "policy", False),
    Threshold("min_mapped_fraction", 0.90, "fraction", "policy", False),
    Threshold("evenness_low", 0.5, "times the mean", "policy", False),
    Threshold("evenness_high", 2.0, "times the mean", "policy", False),
    Threshold("min_evenness", 0.80, "fraction", "policy", False),
    Threshold("gc_tolerance", 0.03, "fraction", "policy", False),
    Threshold("het_min_qual", 20, "phred", "mixture filters"),
    Threshold("het_min_depth", 10, "reads", "mixture filters"),
    Threshold("het_fraction_warn", 0.010, "fraction", "policy", False),
    Threshold("het_fraction_mixed", 0.050, "fraction", "policy", False),
    Threshold("f2_mixture", 0.05, "fraction", "policy", False),
    Threshold("f47_mixture", 0.05, "fraction", "policy", False),
    Threshold("unambiguous", 0.95, "fraction", "legacy pipelines"),
    Threshold("cluster_strict", 5, "SNPs", "published convention"),
    Threshold("cluster_relaxed", 12, "SNPs", "published convention"),
    Threshold("cluster_default", 6, "SNPs", "prior cohort"),
    Threshold("snp_proximity", 12, "bp", "published convention"),
    Threshold("min_shared_callable", 3_000_000, "bp", "policy", False),
    Threshold("barcode_callable", 0.80, "fraction", "policy", False),
    Threshold("barcode_support", 0.90, "fraction", "policy", False),
    Threshold("ani_species", 95.0, "percent", "species boundary"),
    Threshold("ani_mac", 99.0, "percent", "complex members"),
    Threshold("ani_aligned", 0.60, "fraction", "policy", False),
    Threshold("max_non_target", 0.10, "fraction", "policy", False),
    Threshold("taxon_report_floor", 0.005, "fraction", "policy", False),
    Threshold("promoter_window", 1000, "bp", "policy", False),
    Threshold("max_masked", 0.35, "fraction", "policy", False),
)
VALUE = {t.name: t.value for t in ALL}

PLATFORMS = ("illumina", "ont", "fasta")
#: Severity orders, mildest first.
STATUS_ORDER = ("pass", "warn", "fail")
CALL_ORDER = ("S", "S-interim", "no-call", "Uncertain", "R-interim", "R-outside-WHO", "R")
CALL_SEVERITY = {"S": 0, "S-interim": 1, "no-call": 2, "Uncertain": 3, "R-interim": 4, "R-outside-WHO": 5, "R": 6}
CONFIDENCE_ORDER = ("high", "moderate", "low", "none")
VALIDITY_ORDER = ("valid", "not-assessed", "suspect", "invalid")
RESISTANT_CALLS = ("R", "R-interim", "R-outside-WHO")
GRADE_CALL = {1: "R", 2: "R-interim", 3: "Uncertain", 4: "S-interim", 5: "S"}


def min_reads(platform: str) -> int:
    """The read floor of a platform; an unknown platform is an error, not a default."""
    if platform not in PLATFORMS:
        raise ValueError(f"platform must be one of {', '.join(PLATFORMS)}; got {platform!r}")
    return int(VALUE[f"min_reads_{platform}"])


def overridden(overrides: dict[str, float]) -> dict[str, float]:
    """All values with some replaced; names must exist and fractions lie in 0 to 1."""
    units = {t.name: t.unit for t in ALL}
    for name, value in overrides.items():
        if name not in VALUE:
            raise ValueError(f"no threshold is called {name!r}")
        if value < 0 or units[name] == "fraction" and value > 1:
            raise ValueError(f"{name} = {value} is out of range for {units[name]}")
    return VALUE | overrides


def thresholds_table(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """(name, value, unit, source, verified, overridden)."""
    values = overridden(overrides or {})
    rows = [(t.name, float(values[t.name]), t.unit, t.source, t.verified, values[t.name] != t.value) for t in ALL]
    return spark.createDataFrame(rows, "name string, value double, unit string, source string, verified boolean, overridden boolean")
