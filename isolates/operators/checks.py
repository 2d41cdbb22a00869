"""Checks: each measured value against its thresholds, as rows with status, threshold and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolates.functions.expressions import ranked
from isolates.functions.thresholds import STATUS_ORDER, VALUE

#: The quality checks: metric column, category, fail_min, warn_min, fail_max, warn_max, unit, source.
QC_SPEC = (
    ("mean_depth", "qc", 10.0, 25.0, None, None, "reads", "policy"),
    ("breadth", "qc", None, 0.95, None, None, "fraction", "policy"),
    ("evenness", "qc", None, 0.80, None, None, "fraction", "policy"),
    ("mapped_fraction", "qc", None, 0.90, None, None, "fraction", "policy"),
    ("het_fraction", "contamination", None, None, 0.050, 0.010, "fraction", "policy"),
    ("f2", "contamination", None, None, None, 0.05, "fraction", "policy"),
    ("f47", "contamination", None, None, None, 0.05, "fraction", "policy"),
    ("non_target_fraction", "contamination", None, None, None, 0.10, "fraction", "policy"),
)
SPEC = "name string, category string, fail_min double, warn_min double, fail_max double, warn_max double, unit string, source string"


def evaluate(metrics: DataFrame, spec: tuple = QC_SPEC) -> DataFrame:
    """(sample_id, category, name, value, threshold, comparison, unit, status, measured, source), a row for each metric of the spec.

    Metrics are columns of ``metrics``, one row a sample; a column that is missing or NULL is a warning that was not
    measured. Outside a fail bound a check fails, outside a warn bound it warns; the threshold shown is the one that
    decided, or the first that was met.
    """
    spark = metrics.sparkSession
    present = [s[0] for s in spec if s[0] in metrics.columns]
    values = F.create_map(*[x for name in present for x in (F.lit(name), F.col(name).cast("double"))]) if present else F.lit(None).cast("map<string,double>")
    dim = spark.createDataFrame(list(spec), SPEC)
    rows = metrics.select("sample_id", values.alias("__v")).join(F.broadcast(dim), how="cross").withColumn("value", F.col("__v")[F.col("name")])
    v = F.col("value")

    def decided(status: str, threshold: Column, comparison: Column | str) -> Column:
        return F.struct(F.lit(status).alias("status"), threshold.alias("threshold"), (F.lit(comparison) if isinstance(comparison, str) else comparison).alias("comparison"))

    met = F.when(F.coalesce("warn_min", "fail_min").isNotNull(), ">=").otherwise("<=")
    verdict = (
        F.when(v.isNull(), decided("warn", F.lit(None).cast("double"), ""))
        .when(v < F.col("fail_min"), decided("fail", F.col("fail_min"), ">="))
        .when(v > F.col("fail_max"), decided("fail", F.col("fail_max"), "<="))
        .when(v < F.col("warn_min"), decided("warn", F.col("warn_min"), ">="))
        .when(v > F.col("warn_max"), decided("warn", F.col("warn_max"), "<="))
        .otherwise(decided("pass", F.coalesce("warn_min", "fail_min", "warn_max", "fail_max"), met))
    )
    rows = rows.withColumn("x", verdict)
    return rows.select("sample_id", "category", "name", "value", "x.threshold", "x.comparison", "unit", "x.status", F.col("value").isNotNull().alias("measured"), "source")


def boolean_check(flags: DataFrame, column: str, category: str, expected: bool = True, source: str = "policy") -> DataFrame:
    """Check rows of a yes-or-no column; NULL warns as not measured."""
    v = F.col(column)
    status = F.when(v.isNull(), "warn").when(v == expected, "pass").otherwise("fail")
    return flags.select(
        "sample_id", F.lit(category).alias("category"), F.lit(column).alias("name"), v.cast("double").alias("value"), F.lit(float(expected)).alias("threshold"),
        F.lit("==").alias("comparison"), F.lit("").alias("unit"), status.alias("status"), v.isNotNull().alias("measured"), F.lit(source).alias("source"),
    )


#: Shares of a lineage's sites, by name of the check.
LINEAGE_SPEC = (
    ("lineage_callable_fraction", "typing", None, VALUE["barcode_callable"], None, None, "fraction", "policy"),
    ("lineage_support_fraction", "typing", None, VALUE["barcode_support"], None, None, "fraction", "policy"),
)


def lineage_checks(calls: DataFrame) -> DataFrame:
    """Check rows of lineage calls (sample_id, sites_total, sites_callable, sites_supporting, mixed): how many of the lineage's
    sites were callable, how many of those carry its alleles, and whether no other taxon is supported. All warn at worst."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    metrics = calls.select("sample_id", share("sites_callable", "sites_total").alias("lineage_callable_fraction"), share("sites_supporting", "sites_callable").alias("lineage_support_fraction"))
    single = boolean_check(calls.select("sample_id", (F.size("mixed") == 0).alias("lineage_single_taxon")), "lineage_single_taxon", "typing")
    single = single.withColumn("status", F.when(F.col("status") == "fail", "warn").otherwise(F.col("status")))
    return evaluate(metrics, LINEAGE_SPEC).unionByName(single)


def cohort_checks(samples: DataFrame, pairs: DataFrame, clusters: DataFrame, threshold: int, window: int | None = None, masked: bool = True, floor: int | None = None) -> DataFrame:
    """(name, value, threshold, comparison, unit, status, measured): one row for each check of a whole cohort.

    ``pairs``: snps (NULL: not computed) and shared_callable_sites; ``clusters``: cluster_id and max_distance, a row a
    cluster. Size, mask, proximity window, thinnest denominator, computed pairs, the threshold's basis, pairs fit for
    clustering and chained clusters. Only an absent mask fails; without pairs, what they would show is not measured.
    """
    window = int(VALUE["snp_proximity"]) if window is None else window
    floor = int(VALUE["min_shared_callable"]) if floor is None else floor
    thin = F.col("snps").isNotNull() & (F.coalesce("shared_callable_sites", F.lit(0)) < floor)
    over_pairs = pairs.agg(F.count("*").alias("pairs"), F.count("snps").alias("computed"), F.count_if(thin).alias("thin"), F.min("shared_callable_sites").alias("least"))
    over = samples.agg(F.count_distinct("sample_id").alias("samples")).join(over_pairs, how="cross")
    over = over.join(clusters.agg(F.count_if(F.col("max_distance") > threshold).alias("chained")), how="cross")
    c, none = F.col, F.lit(None).cast("double")
    some = c("pairs") > 0

    def row(name: str, value: Column, limit: Column, comparison: str, unit: str, status: Column) -> Column:
        cells = (F.lit(name).alias("name"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"), F.lit(comparison).alias("comparison"), F.lit(unit).alias("unit"), status.alias("status"))
        return F.struct(*cells, value.isNotNull().alias("measured"))

    passes = lambda met, other="warn": F.when(met, "pass").otherwise(other)
    of_pairs = lambda value: F.when(some, value)
    published = threshold in {int(VALUE[k]) for k in ("cluster_strict", "cluster_relaxed", "cluster_default")}
    fit = c("computed") - c("thin")
    rows = [
        row("cohort_size", c("samples"), F.lit(2), ">=", "samples", passes(c("samples") >= 2)),
        row("mask_applied", F.lit(float(masked)), F.lit(1), "==", "", passes(F.lit(masked), "fail")),
        row("snp_proximity_window", F.lit(window), F.lit(int(VALUE["snp_proximity"])), "==", "bp", passes(F.lit(window == int(VALUE["snp_proximity"])))),
        row("min_shared_callable_sites", c("least"), F.when(c("least").isNotNull(), F.lit(floor)).otherwise(none), ">=", "bp", passes(c("least") >= floor)),
        row("pairs_computed", of_pairs(c("computed")), c("pairs"), "==", "pairs", passes(some & (c("computed") == c("pairs")))),
        row("cluster_threshold", F.lit(threshold), none, "", "SNPs", passes(F.lit(published))),
        row("pairs_used_for_clustering", of_pairs(fit), c("pairs"), "==", "pairs", passes(some & (fit == c("pairs")))),
        row("single_linkage_chaining", of_pairs(c("chained")), F.lit(0), "<=", "clusters", passes(some & (c("chained") == 0))),
    ]
    return over.select(F.inline(F.array(*rows)))


def overall(checks: DataFrame) -> DataFrame:
    """(sample_id, status, failed, unmeasured): the worst status, and the names that failed or were not measured."""
    return checks.groupBy("sample_id").agg(
        F.max_by("status", ranked(STATUS_ORDER, F.col("status"))).alias("status"),
        F.sort_array(F.collect_set(F.when(F.col("status") == "fail", F.col("name")))).alias("failed"),
        F.sort_array(F.collect_set(F.when(~F.col("measured"), F.col("name")))).alias("unmeasured"),
    )
