import pytest
from pyspark.sql import functions as F

from isolates.functions import thresholds
from isolates.operators import checks, cohort, intervals, report
from isolates.sources import readers


def test_assembled_cohort(spark):
    snps = {"a": {5: "T", 40: "G"}, "b": {5: "T"}, "c": {5: "T", 40: "G", 70: "C", 90: "T"}, "d": {}}
    rows = [(s, "c", p, "A", alt, ["PASS"], 1.0, "") for s, seen in snps.items() for p, alt in seen.items()]
    variants = spark.createDataFrame(rows, "sample_id string, chrom string, pos int, ref string, alt string, filters array<string>, allele_fraction double, gene string").withColumn("is_major", F.lit(True))
    variants = cohort.usable_variants(variants)
    regions = spark.createDataFrame([("a", "c", 0, 100), ("b", "c", 0, 100), ("c", "c", 0, 100)], "sample_id string, chrom string, start_pos int, end_pos int")
    mask = spark.createDataFrame([("c", 88, 95)], "chrom string, start_pos int, end_pos int")
    samples = spark.createDataFrame([(s,) for s in snps], "sample_id string")
    made = cohort.assemble(variants, regions, mask, samples, 1, 50)
    pairs = {(r.sample_a, r.sample_b): r for r in made["pairs"].collect()}
    assert {k: r.snps for k, r in pairs.items() if "d" not in k} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2}
    assert all(r.state == "uncomputed" and r.snps is None and not r.same_cluster for k, r in pairs.items() if "d" in k) and len(pairs) == 6
    assert pairs["b", "c"].same_cluster and not pairs["b", "c"].within and pairs["b", "c"].shared_callable_sites == 93
    assert {r.sample_id: r.cluster_id for r in made["members"].collect()} == {"a": "C1", "b": "C1", "c": "C1", "d": None}
    assert cohort.pair_of(made["pairs"], "c", "a").count() == 1 and cohort.pair_of(made["pairs"], "a", "a").count() == 0
    assert made["table"].count() == 4 * 4
    got = {r.name: (r.value, r.status) for r in made["checks"].collect()}
    assert got["cohort_size"] == (4, "pass") and got["mask_applied"] == (1, "pass") and got["pairs_computed"] == (3, "warn")
    assert got["cluster_threshold"] == (1, "warn") and got["single_linkage_chaining"] == (1, "warn") and got["min_shared_callable_sites"] == (93, "pass")


def test_checks_of_a_cohort_of_one(spark):
    samples = spark.createDataFrame([("a",)], "sample_id string")
    pairs = spark.createDataFrame([], "sample_a string, sample_b string, snps long, shared_callable_sites long")
    clusters = spark.createDataFrame([], "cluster_id string, max_distance long")
    got = {r.name: r for r in checks.cohort_checks(samples, pairs, clusters, 12, window=0, masked=False).collect()}
    assert got["mask_applied"].status == "fail" and got["cohort_size"].status == "warn" and got["snp_proximity_window"].status == "warn"
    for name in ("pairs_computed", "pairs_used_for_clustering", "single_linkage_chaining", "min_shared_callable_sites"):
        assert not got[name].measured and got[name].status == "warn"
    assert got["cluster_threshold"].status == "pass"


def test_lineage_checks(spark):
    calls = spark.createDataFrame([("a", 10, 9, 9, []), ("b", 10, 5, 4, ["lineage2"]), ("c", None, None, None, [])], "sample_id string, sites_total int, sites_callable int, sites_supporting int, mixed array<string>")
    got = {(r.sample_id, r.name.removeprefix("lineage_")): (r.status, r.measured) for r in checks.lineage_checks(calls).collect()}
    assert got["a", "callable_fraction"] == got["a", "support_fraction"] == got["a", "single_taxon"] == ("pass", True)
    assert got["b", "callable_fraction"] == got["b", "support_fraction"] == got["b", "single_taxon"] == ("warn", True)
    assert got["c", "callable_fraction"] == got["c", "support_fraction"] == ("warn", False) and got["c", "single_taxon"] == ("pass", True)


def test_plot_points_and_graded_rows(spark):
    variants = spark.createDataFrame([("s", v, "c", i, f, 20) for i, (v, f) in enumerate([("v1", 0.5), ("v2", None), ("v3", 1.0)])], "sample_id string, variant_id string, chrom string, pos int, allele_fraction double, depth int")
    parts = spark.createDataFrame([("s", "v1", "third", "rif", "1", "R"), ("s", "v1", "flat", "inh", "5", "S"), ("s", "v2", "WHO", "inh", "3", "Uncertain")], "sample_id string, variant_id string, catalogue string, drug string, grade string, call string").withColumn("matched_by", F.lit("alias"))
    calls = spark.createDataFrame([("s", "rif", "R-outside-WHO", ["v1"]), ("s", "inh", "S", [])], "sample_id string, drug string, call string, supporting_variants array<string>")
    got = {r.variant_id: r for r in report.plot_points(variants, parts, calls).collect()}
    assert (got["v1"].call, got["v1"].catalogue_call, got["v1"].drugs) == ("R-outside-WHO", "R", ["inh", "rif"])
    assert (got["v2"].call, got["v2"].allele_fraction) == ("Uncertain", None)
    assert (got["v3"].call, got["v3"].catalogued, got["v3"].drugs) == ("no-call", False, [])
    assert report.graded_rows(variants, parts).count() == 3


def test_unverified_thresholds(spark):
    rows = {r.name: r.why for r in report.unverified_rows(thresholds.thresholds_table(spark, {"cluster_strict": 4.0})).collect()}
    assert rows["cluster_strict"] == "overridden" and rows["min_breadth"] == "unverified" and "cluster_relaxed" not in rows


def test_unreadable_report(spark, tmp_path):
    (tmp_path / "good.txt").write_text("10.0\t5\t5\tS\t1\tx\nbroken\n")
    assert readers.require_some_rows(readers.read_classifier_report(spark, str(tmp_path / "good.txt"))).count() == 1
    (tmp_path / "bad.txt").write_text("broken\nalso broken\n")
    with pytest.raises(ValueError, match="bad"):
        readers.require_some_rows(readers.read_classifier_report(spark, str(tmp_path / "bad.txt")))


def test_mean_width(spark):
    schema = "chrom string, start_pos int, end_pos int"
    assert intervals.mean_width(spark.createDataFrame([("c", 0, 1), ("c", 5, 9)], schema)) == 3
    assert intervals.mean_width(spark.createDataFrame([], schema)) == 1
    a = spark.createDataFrame([("c", 0, 7), ("c", 9, 12), ("d", 1, 4)], schema)
    for width in (1, 3, 1000):
        met = intervals.overlap_join(a, a.withColumnsRenamed({}), ["chrom"], width)
        assert sorted((r.chrom, r.start_pos, r.end_pos) for r in met.collect()) == [("c", 0, 7), ("c", 9, 12), ("d", 1, 4)]
