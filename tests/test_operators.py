import pytest
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions import hgvs as H
from isolates.functions import thresholds as T
from isolates.operators import catalogue as K
from isolates.operators import checks as Q
from isolates.operators import cohort, contamination, coverage
from isolates.operators import intervals as I
from isolates.operators import lineage as L
from isolates.operators import naming as N
from isolates.operators import report as P
from isolates.operators import resistance as R
from isolates.operators import sites as S
from isolates.operators import species as Z
from isolates.operators import textaudit as A
from isolates.operators.components import connected_components

COUNTS = "sample_id string, chrom string, pos int, n_a long, n_c long, n_g long, n_t long"


def values(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_genotypes(spark):
    rows = [("s", "c", 1, 9, 1, 0, 0), ("s", "c", 2, 5, 5, 0, 0), ("s", "c", 3, 2, 0, 0, 0), ("s", "c", 4, 6, 4, 0, 0), ("s", "c", 5, 0, 0, 0, 0)]
    sites = spark.createDataFrame(rows, COUNTS)
    got = {r.pos: (r.allele, r.reason) for r in S.genotype_sites(sites, "illumina", 0.9).collect()}
    assert got == {1: ("A", ""), 2: (None, "tie"), 3: ("A", "few reads"), 4: ("A", "low fraction"), 5: (None, "no reads")}
    assert {r.pos: r.reason for r in S.genotype_sites(sites, "ont").collect()}[4] == ""
    legacy = {r.pos: r.allele for r in S.with_alleles(sites.withColumns({"n_n": F.lit(0), "n_gap": F.lit(5)}), "legacy").collect()}
    assert legacy[2] == "-" and legacy[1] == "A"
    with pytest.raises(ValueError):
        S.genotype_sites(sites, "nanopore")


def test_fraction_at(spark):
    df = spark.createDataFrame([("s", "c", 1, 6, 2, 0, 0, {"GT": 4}, {"A": 2}, True), ("s", "c", 2, 0, 0, 0, 0, {}, {}, False)], COUNTS + ", ins map<string,int>, del map<string,int>, covered boolean").orderBy("pos")
    at = lambda r, a: [x[0] for x in df.select(S.allele_fraction_at(F.lit(r), F.lit(a))).collect()]
    assert at("A", "C") == [0.25, None] and at("A", "AGT") == [0.5, None] and at("CA", "C") == [0.25, None] and at("AC", "GT") == [None, None]


def test_backfill_and_guards(spark):
    sites = spark.createDataFrame([("s", "c", 1, 6, 2, 0, 0)], COUNTS)
    v = spark.createDataFrame([("s", "c", 1, "A", "C", None), ("s", "c", 1, "A", "C", 0.9), ("s", "c", 2, "A", "C", None)], "sample_id string, chrom string, pos int, ref string, alt string, allele_fraction double")
    assert sorted(str(r.allele_fraction) for r in S.backfill_fractions(v, sites).collect()) == ["0.25", "0.9", "None"]
    calls = spark.createDataFrame([("s", "c", 1, "A", "C", 6, 2, 30.0), ("s", "c", 2, "A", "C", None, 2, 30.0), ("s", "c", 3, "AT", "A", 1, 2, 3.0)], "sample_id string, chrom string, pos int, ref string, alt string, ref_reads int, alt_reads int, qual double")
    assert [tuple(r) for r in S.snp_observations(calls).collect()] == [("s", "c", 1, 6, 2, 0, 0, 30.0)]
    S.require_shared_contigs(sites, sites, "x")
    with pytest.raises(ValueError, match="no contig"):
        S.require_shared_contigs(sites, sites.withColumn("chrom", F.lit("z")), "x")
    with pytest.raises(ValueError, match="different references"):
        S.require_one_reference(spark.createDataFrame([("a", "r1"), ("b", "r2")], "sample_id string, reference string"))
    stats = coverage.assembly_stats(spark.createDataFrame([("s", "ACGT" * 5), ("s", "GGNN"), ("s", "A")], "sample_id string, seq string")).first()
    assert (stats.contigs, stats.bases, stats.n50, stats.gc, stats.ambiguous) == (3, 25, 20, 12 / 23, 2)


def test_contig_names(spark):
    sites = spark.createDataFrame([("s1", "NC_1"), ("s2", "other"), ("s3", "x"), ("s3", "y")], "sample_id string, chrom string")
    aliases = spark.createDataFrame([("NC_1", "Chromosome")], "alias string, chrom string")
    scheme = spark.createDataFrame([("Chromosome",)], "chrom string")
    got = sorted(tuple(r) for r in S.translate_contigs(sites, aliases, scheme).collect())
    assert got == [("s1", "Chromosome"), ("s2", "Chromosome"), ("s3", "x"), ("s3", "y")]


def barcode_case(spark, counts):
    scheme = [("c", p, t, ["A"], "fam" if t == "lineage2" else "") for t, ps in (("lineage2", range(1, 11)), ("lineage2.2", range(11, 19)), ("lineage4", range(19, 24))) for p in ps]
    barcode = spark.createDataFrame(scheme, "chrom string, pos int, taxon string, alleles array<string>, family string")
    taxon = {p: t for _, p, t, *_ in scheme}
    rows = [("s", "c", p, a, c, 0, 0) for p in taxon for a, c in [counts.get(taxon[p], (0, 30))]]
    support = L.taxon_support(L.genotype_barcode(spark.createDataFrame(rows, COUNTS), barcode, "illumina"))
    return support, L.call_lineages(support).first()


def test_lineage(spark):
    support, call = barcode_case(spark, {"lineage2": (30, 0), "lineage2.2": (30, 0)})
    assert (call.lineage, call.sublineage, call.confidence, call.mixed) == ("lineage2", "lineage2.2", "high", [])
    assert L.family_of(support, L.call_lineages(support)).first().family == "fam"
    _, call = barcode_case(spark, {"lineage2.2": (30, 0)})
    assert (call.taxon, call.consistent) == ("lineage2.2", False)
    _, call = barcode_case(spark, {"lineage2": (20, 10), "lineage4": (10, 20)})
    assert (call.taxon, call.mixed, call.confidence) == ("lineage2", ["lineage4"], "moderate")
    _, call = barcode_case(spark, {})
    assert call.lineage is None and call.confidence == "none"


def test_coverage(spark):
    depths = spark.createDataFrame([("s", "c", p, d) for p, d in enumerate([10, 20, 30, 0, 12, 15], 1)], "sample_id string, chrom string, pos int, depth int")
    lengths = spark.createDataFrame([("s", 8), ("empty", 4)], "sample_id string, length long")
    got = {r.sample_id: r for r in coverage.coverage(coverage.merge_contigs(coverage.depth_histogram(depths)), lengths).collect()}
    assert (got["s"].positions, got["s"].mean_depth, got["s"].median_depth, got["s"].breadth) == (8, 87 / 8, 11.0, 5 / 8)
    assert got["empty"].mean_depth == 0 and got["empty"].evenness is None
    runs = coverage.callable_regions(depths).collect()
    assert sorted((r.start_pos, r.end_pos) for r in runs) == [(0, 3), (4, 6)]


def test_intervals(spark):
    schema = "set_id string, chrom string, start_pos int, end_pos int"
    a = spark.createDataFrame([("a", "c", 0, 5), ("a", "c", 5, 8), ("a", "c", 20, 40), ("a", "c", 30, 31), ("a", "c", 9, 9), ("a", "d", 0, 25_000)], schema)
    merged = I.merge_intervals(a)
    assert sorted(tuple(r)[1:] for r in merged.select("set_id", "chrom", "start_pos", "end_pos").collect()) == [("c", 0, 8), ("c", 20, 40), ("d", 0, 25_000)]
    b = spark.createDataFrame([("b", "c", 3, 22), ("b", "d", 9_990, 20_010)], schema)
    keys = ["chrom"]
    rows = lambda df: sorted((r.chrom, r.start_pos, r.end_pos) for r in df.collect())
    assert rows(I.intersect(merged, b, keys)) == [("c", 3, 8), ("c", 20, 22), ("d", 9_990, 20_010)]
    assert rows(I.subtract(merged, b, keys)) == [("c", 0, 3), ("c", 22, 40), ("d", 0, 9_990), ("d", 20_010, 25_000)]
    spots = spark.createDataFrame([("c", 8), ("c", 9), ("d", 25_000), ("d", 25_001)], "chrom string, pos int")
    assert sorted((r.chrom, r.pos) for r in I.inside(spots, merged, keys).collect()) == [("c", 8), ("d", 25_000)]
    assert I.inside(spots, merged, keys, "left_anti").count() == 2


def test_sequence_masks(spark):
    seqs = spark.createDataFrame([("c", "ACGT" * 10 + "A" * 15 + "CGTA" * 10), ("d", "AT" * 40)], "chrom string, seq string")
    assert [tuple(r) for r in I.homopolymers(seqs).collect()] == [("c", 40, 55)]
    assert ("d", 0, 72) in [tuple(r) for r in I.low_complexity(seqs).select("chrom", "start_pos", "end_pos").collect()]
    contigs = spark.createDataFrame([("c", 100), ("d", 80)], "chrom string, length long")
    with pytest.raises(ValueError, match="covers"):
        I.build_mask([I.whole_contigs(contigs)], contigs, 0.35)


def test_names(spark):
    rows = [("S450L",), ("p.Ser450Leu",), ("c.123a>g",), ("LoF",), ("12_13delAc",), ("p.Trp5*",)]
    got = values(spark, "x string", rows, n=H.normalise(F.col("x")))
    assert [r[0] for r in got] == ["p.Ser450Leu", "p.Ser450Leu", "c.123A>G", "LoF", "c.12_13delAC", "p.Trp5Ter"]
    keys = values(spark, "g string, x string", [("rpoB", "p.Ser450Leu"), ("rrs", "n.1401A>G"), ("katG", "p.Ser315Thr")], k=H.alias_keys(F.col("g"), F.col("x")))
    assert keys[0][0] == ["rpoB_p.S450L", "rpoB_p.Ser531Leu", "rpoB_p.S531L"] and keys[1][0] == ["rrs_n.1408A>G"] and keys[2][0] == ["katG_p.S315T"]
    kinds = values(spark, "a string, b string", [("S450L", "p.Ser450Leu"), ("p.Ser450Leu", "p.Ser531Leu"), ("p.Ser450Leu", "p.Ser450Trp")], k=H.difference_kind(F.lit("rpoB"), F.col("a"), F.col("b")))
    assert [k[0] for k in kinds] == ["none", "nomenclature", "biological"]
    trimmed = values(spark, "p int, r string, a string", [(10, "ACGT", "ACT"), (5, "GAT", "GCT"), (7, "A", "AT")], t=E.trimmed(F.col("p"), F.col("r"), F.col("a")))
    assert [tuple(t[0]) for t in trimmed] == [(11, "CG", "C"), (6, "A", "C"), (7, "A", "AT")]
    order = values(spark, "x string", [("S10",), ("S2",), ("S2b",), ("s1",)], k=E.natural_key(F.col("x")))
    assert sorted(range(4), key=lambda i: order[i][0]) == [3, 1, 2, 0]


def test_naming_on_genes(spark):
    seq = "T" * 9 + "ATGGCTTGGTAA" + "T" * 9
    other = seq[:9] + "TTACCAAGCCAT" + "T" * 9  # the same gene on the other strand
    seqs = spark.createDataFrame([("p", seq), ("m", other)], "chrom string, seq string")
    genes = spark.createDataFrame([("g", "p", 10, 21, "+"), ("h", "m", 10, 21, "-")], "name string, chrom string, start_pos int, end_pos int, strand string")
    cases = [("p", 13, "G", "T"), ("p", 15, "T", "C"), ("p", 18, "G", "A"), ("p", 12, "G", "A"), ("p", 5, "T", "C"), ("m", 18, "C", "A"), ("m", 22, "T", "G")]
    v = spark.createDataFrame([("s", f"{c}{p}{a}", c, p, r, a) for c, p, r, a in cases], "sample_id string, variant_id string, chrom string, pos int, ref string, alt string")
    named = {r.variant_id: (r.hgvs, r.effect) for r in N.name_substitutions(N.gene_context(v, genes, 100), seqs).collect()}
    assert named["p13T"] == ("p.Ala2Ser", "missense_variant") and named["p15C"] == ("c.6T>C", "synonymous_variant")
    assert named["p18A"] == ("p.Trp3Ter", "stop_gained") and named["p12A"] == ("c.3G>A", "start_lost")
    assert named["p5C"] == ("c.-5T>C", "upstream_variant") and named["m18A"] == ("p.Ala2Ser", "missense_variant") and named["m22G"] == ("c.-1A>C", "upstream_variant")
    block = spark.createDataFrame([("s", "b", "p", 13, "GCT", "TGA")], v.schema)
    assert tuple(N.name_blocks(N.gene_context(block, genes, 100), seqs).select("hgvs", "effect").first()) == ("p.Ala2Ter", "stop_gained")
    lost = spark.createDataFrame([("s", "d", "p", 8, "T" * 15, "T")], v.schema)
    assert N.genes_lost(lost, genes).first().gene == "g"
    repeat = spark.createDataFrame([("c", "GGCACACACATT")], "chrom string, seq string")
    moved = spark.createDataFrame([("s", "x", "c", 7, "CAC", "C"), ("s", "y", "c", 8, "A", "ACA"), ("s", "z", "c", 3, "C", "T")], v.schema)
    aligned = {r.variant_id: (r.pos, r.ref, r.alt) for r in N.left_align(moved, repeat).collect()}
    assert aligned == {"x": (2, "GCA", "G"), "y": (2, "G", "GCA"), "z": (3, "C", "T")}


VARIANT = "sample_id string, variant_id string, chrom string, pos int, ref string, alt string, gene string, hgvs string, effect string, allele_fraction double, alt_reads int, filters array<string>"
ENTRY = "entry_id long, catalogue string, drug string, gene string, hgvs string, grade int, call string, comment string"


def variants(spark, *rows):
    return R.platform_filters(spark.createDataFrame([("s", v, "c", p, "A", "T", g, h, e, af, n, ["PASS"]) for v, p, g, h, e, af, n in rows], VARIANT), "illumina")


def test_routes_and_consensus(spark):
    found = variants(spark, ("v1", 10, "rpoB", "p.Ser450Leu", "", 0.99, 50), ("v2", 20, "rpoB", "p.Ser531Leu", "", 0.99, 50), ("v3", 30, "katG", "p.Ser315Thr", "", 0.99, 2), ("v4", 40, "gyrA", "p.Ala90Val", "", 0.95, 30))
    entries = spark.createDataFrame(
        [(1, "WHO", "Rifampicin", "rpoB", "p.Ser450Leu", 1, "R", ""), (2, "flat", "rifampicin", "rpoB", "p.Leu430Pro", None, "R", ""), (3, "WHO", "isoniazid", "katG", "p.Ser315Thr", 1, "R", ""), (4, "third", "moxifloxacin", "gyrA", "p.A90V", None, "R", ""), (5, "third", "rifampicin", "rpoB", "p.Ser450Leu", 5, "S", "")], ENTRY
    )
    coords = spark.createDataFrame([(2, "c", 10, "A", "T"), (1, "c", 10, "A", "T")], "entry_id long, chrom string, pos int, ref string, alt string")
    routes = {(r.variant_id, r.entry_id): r.matched_by for r in K.match(found, entries, coords).collect()}
    assert routes == {("v1", 1): "coordinate", ("v1", 2): "coordinate", ("v1", 5): "hgvs", ("v2", 1): "alias", ("v2", 5): "alias", ("v3", 3): "hgvs", ("v4", 4): "hgvs"}
    parts = R.contributions(K.calls_for(found, entries, coords), found, "illumina")
    covered = spark.createDataFrame([("s", "moxifloxacin", False)], "sample_id string, drug string, target_covered boolean")
    calls = {r.drug: r for r in R.consensus(parts, "illumina", covered).collect()}
    assert (calls["rifampicin"].call, calls["rifampicin"].confidence, calls["rifampicin"].disagreement_kind) == ("R", "moderate", "biological")
    assert calls["isoniazid"].call == "Uncertain" and "min_reads" in calls["isoniazid"].suppressed_by and calls["isoniazid"].confidence == "low"
    assert (calls["moxifloxacin"].call, calls["moxifloxacin"].confidence) == ("R-outside-WHO", "none")
    panel = spark.createDataFrame([("rifampicin",), ("ethambutol",)], "drug string")
    full = {r.drug: r.call for r in R.complete_panel(R.consensus(parts, "illumina"), found, panel).collect()}
    assert full["ethambutol"] == "no-call" and len(full) == 4
    report = {r.drug: r for r in P.drug_rows(R.consensus(parts, "illumina"), parts).collect()}
    assert (report["rifampicin"].call_WHO, report["rifampicin"].call_flat, report["rifampicin"].call_third) == ("R", "R", "S")
    assert report["moxifloxacin"].call_WHO == "not-consulted"


def test_rules_and_epistasis(spark):
    v = variants(
        spark, ("a", 1, "rpoB", "p.Leu430Pro", "", 0.99, 9), ("b", 2, "rpoB", "p.Ser441Val", "", 0.99, 9), ("c", 3, "pncA", "p.Trp68fs", "frameshift", 0.99, 9), ("d", 4, "gyrA", "p.Ala10=", "synonymous_variant", 0.99, 9),
        ("e", 5, "mmpL5", "p.Gln5Ter", "stop_gained", 0.99, 9), ("f", 6, "Rv0678", "p.Arg3Gly", "", 0.99, 9), ("g", 7, "eis", "c.-14C>T", "", 0.99, 9), ("h", 8, "eis", "p.Gln5Ter", "stop_gained", 0.3, 9),
    )
    drugs = spark.createDataFrame([("gyra", ["levofloxacin"])], "gene string, drugs array<string>")
    graded = spark.createDataFrame([("s", "b", "rifampicin")], "sample_id string, variant_id string, drug string")
    got = {(r.variant_id, r.drug, r.grade, r.call) for r in R.rule_calls(v, graded, drugs).collect()}
    assert got == {("a", "rifampicin", 1, "R"), ("c", "pyrazinamide", 2, "R-interim"), ("d", "levofloxacin", 4, "S-interim")}
    found = {(r.variant_id, r.drug, r.confident) for r in R.epistasis(v).collect()}
    assert found == {("f", "bedaquiline", True), ("f", "clofazimine", True), ("g", "amikacin", False), ("g", "kanamycin", False)}


def test_distance_details(spark):
    v = [("a", "c", 10, "A", "T", 1.0), ("b", "c", 50, "A", "G", 1.0), ("b", "c", 55, "A", "C", 1.0), ("a", "c", 100, "A", "G", 0.5), ("b", "c", 200, "AT", "A", 1.0), ("a", "c", 300, "A", "G", 1.0), ("b", "c", 300, "A", "G", 1.0), ("a", "c", 305, "A", "G", 1.0), ("a", "c", 905, "A", "T", 1.0), ("b", "c", 400, "A", "T", 1.0)]
    rows = [(s, f"{p}", ch, p, r, x, "", af, ["PASS"], af >= 0.9) for s, ch, p, r, x, af in v]
    table = cohort.usable_variants(spark.createDataFrame(rows, "sample_id string, variant_id string, chrom string, pos int, ref string, alt string, gene string, allele_fraction double, filters array<string>, is_major boolean"))
    regions = spark.createDataFrame([("a", "c", 0, 800), ("b", "c", 0, 1000)], "sample_id string, chrom string, start_pos int, end_pos int")
    mask = spark.createDataFrame([("c", 390, 410)], "chrom string, start_pos int, end_pos int")
    samples = spark.createDataFrame([("a",), ("b",), ("z",)], "sample_id string")
    got = {(r.sample_a, r.sample_b): r for r in cohort.pairwise_distances(table, regions, mask, samples).collect()}
    ab = got["a", "b"]
    # 10 counts; 50 and 55 are close; 100 is ambiguous; 200 is an indel; 305 is close to 300, which both have; 400 is masked; 905 outside
    assert (ab.snps, ab.shared_callable_sites, ab.masked_sites, ab.indel_sites, ab.ambiguous_sites) == (1, 779, 20, 1, 1)
    assert got["a", "z"].snps is None and got["a", "z"].shared_callable_sites is None
    assert cohort.pairwise_distances(table, regions, mask, samples, window=0).filter("sample_b = 'b'").first().snps == 4


def test_clusters_and_tree(spark):
    pairs = [("S1", "S2", 3), ("S2", "S10", 6), ("S1", "S10", 9), ("S4", "S5", 1), ("S4", "S6", None), ("S5", "S6", 40)]
    df = spark.createDataFrame([(a, b, d, 4_000_000) for a, b, d in pairs] + [("S6", "S7", 0, 10)], "sample_a string, sample_b string, snps long, shared_callable_sites long")
    samples = spark.createDataFrame([(f"S{i}",) for i in (1, 2, 4, 5, 6, 7, 10)], "sample_id string")
    members = {r.sample_id: r.cluster_id for r in cohort.cluster_members(samples, df).collect()}
    assert members == {"S1": "C1", "S2": "C1", "S10": "C1", "S4": "C2", "S5": "C2", "S6": None, "S7": None}
    summary = cohort.cluster_summary(cohort.cluster_members(samples, df), df, 6).orderBy("cluster_id").first()
    assert (summary.members, summary.max_distance, summary.chained) == (["S1", "S2", "S10"], 9, True)
    tree = sorted((r.left, r.right, r.height, r["size"]) for r in cohort.upgma(spark.createDataFrame([("a", "b", 2), ("a", "c", 6), ("b", "c", 8), ("a", "d", 20), ("b", "d", 20), ("c", "d", 20)], "sample_a string, sample_b string, snps int")).collect())
    assert tree == [("a", "b", 1.0, 2), ("a", "c", 3.5, 3), ("a", "d", 10.0, 4)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and 200 not in got
    assert connected_components(edges.filter("false")).count() == 0


def test_validity_and_checks(spark):
    schema = "sample_id string, mixture string, mapped_fraction double, breadth double, evenness double, gc_within boolean, non_target_fraction double, unambiguous_fraction double"
    panel = spark.createDataFrame([("a", "single-strain", 0.99, 0.99, 0.9, True, None, 0.99), ("b", "possible-mixture", 0.99, 0.99, None, None, None, None), ("c", "not-assessed", None, None, None, None, None, None)], schema)
    got = {(r.sample_id, r.use): (r.verdict, r.reasons) for r in contamination.sample_validity(panel).collect()}
    assert got["a", "resistance"][0] == got["a", "transmission"][0] == "valid"
    assert got["b", "resistance"] == ("suspect", ["mixture"]) and got["b", "transmission"][0] == "invalid" and got["c", "resistance"][0] == "not-assessed"
    metrics = spark.createDataFrame([("a", 30.0, 0.90, None), ("b", 5.0, 0.99, 0.2)], "sample_id string, mean_depth double, breadth double, het_fraction double")
    rows = {(r.sample_id, r.name): r for r in Q.evaluate(metrics).collect()}
    assert len(rows) == 2 * len(Q.QC_SPEC) and rows["a", "breadth"].status == "warn" and rows["b", "mean_depth"].status == "fail"
    assert rows["a", "het_fraction"].measured is False and rows["a", "mean_depth"].threshold == 25.0
    assert {r.sample_id: r.status for r in Q.overall(Q.evaluate(metrics)).collect()} == {"a": "warn", "b": "fail"}


def test_thresholds(spark):
    assert T.overridden({"min_breadth": 0.5})["min_breadth"] == 0.5
    for bad in ({"nothing": 1}, {"min_breadth": 1.5}, {"callable_depth": -1}):
        with pytest.raises(ValueError):
            T.overridden(bad)
    assert T.thresholds_table(spark).count() == len(T.ALL)
    down = values(spark, "c string, k int", [("high", 1), ("low", 2), ("none", 1), ("high", 0)], d=E.downgrade(F.col("c"), F.col("k")))
    assert [d[0] for d in down] == ["moderate", "none", "none", "high"]


def test_species(spark):
    schema = "sample_id string, name string, complex string, ani double, aligned_fraction double"
    rows = [("a", "M. bovis", "MTBC", 99.9, 0.95), ("b", "M. chimaera", "MAC", 99.5, 0.9), ("b", "M. avium", "MAC", 96.0, 0.9), ("c", "M. x", None, 97.0, 0.9), ("d", "M. x", None, 90.0, 0.9), ("e", "M. x", None, 99.0, 0.1)]
    markers = spark.createDataFrame([("b", "M. chimaera")], "sample_id string, marker_species string")
    got = {r.sample_id: (r.name, r.resolved, r.confidence) for r in Z.identify(spark.createDataFrame(rows, schema), markers).collect()}
    assert got == {"a": ("MTBC", False, "high"), "b": ("M. chimaera", True, "moderate"), "c": ("M. x", True, "high"), "d": ("unresolved", False, "none"), "e": ("unresolved", False, "low")}
    import random

    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(4000))
    near = "".join(rng.choice("ACGT") if rng.random() < 0.02 else b for b in base)
    far = "".join(rng.choice("ACGT") for _ in range(4000))
    sketch = lambda *s: Z.sketches(spark.createDataFrame(list(s), "id string, seq string"))
    found = Z.sketch_identity(sketch(("q", base)), sketch(("near", near), ("far", far))).collect()
    assert [r.reference for r in found] == ["near"] and 97 < found[0].ani < 99.9


def test_indel_names(spark):
    genes = spark.createDataFrame([("g", "p", 10, 30, "+", "protein_coding"), ("r", "m", 10, 30, "-", "rRNA"), ("h", "n", 10, 30, "-", "protein_coding")], "name string, chrom string, start_pos int, end_pos int, strand string, biotype string")
    cases = [("p", 14, "AC", "A"), ("p", 14, "ACGT", "A"), ("p", 8, "ACG", "A"), ("p", 14, "A", "ACGT"), ("p", 14, "A", "AC"), ("m", 14, "AC", "A"), ("n", 14, "A", "ACG"), ("p", 5, "AC", "A")]
    v = spark.createDataFrame([("s", str(i), *c) for i, c in enumerate(cases)], "sample_id string, variant_id string, chrom string, pos int, ref string, alt string")
    got = {int(r.variant_id): (r.hgvs, r.effect) for r in N.name_indels(N.gene_context(v, genes, 100)).collect()}
    assert got[0] == ("p.Xaa2fs", "frameshift_variant") and got[1] == ("c.6_8delCGT", "inframe_deletion")
    assert got[2] == ("c.-1_1delCG", "start_lost")
    assert got[3] == ("c.5_6insCGT", "inframe_insertion") and got[4] == ("p.Xaa2fs", "frameshift_variant")
    assert got[5] == ("n.16delG", "non_coding_variant") and got[6] == ("p.Xaa6fs", "frameshift_variant") and got[7] == ("c.-4delC", "upstream_variant")
    seqs = spark.createDataFrame([("p", "T" * 9 + "ATGGCTGCTGCATGGAAATAA" + "T")], "chrom string, seq string")
    shift = spark.createDataFrame([("s", "f", "p", 12, "GG", "G")], v.schema)
    assert N.frameshift_codons(N.gene_context(shift, genes, 100), seqs).first().hgvs == "p.Ala2fs"


def test_ntm(spark):
    from isolates.operators import ntm

    samples = spark.createDataFrame([("a", "Mycobacteroides abscessus"), ("b", "ABSCESSUS"), ("c", "Mycobacterium avium"), ("d", "other")], "sample_id string, organism string")
    v = spark.createDataFrame([("a", "rrl", "n.2058A>G"), ("c", "rrs", "n.1408A>C"), ("c", "rrs", "n.1409C>T")], "sample_id string, gene string, hgvs string")
    erm = ntm.erm41_states(spark.createDataFrame([("a", True, 0.99, "C"), ("b", True, 0.5, "T"), ("c", None, None, "T")], "sample_id string, present boolean, body_coverage double, base string"))
    genes = spark.createDataFrame([("a", "rrs", True), ("b", "rrl", False)], "sample_id string, gene string, callable boolean")
    drugs = spark.createDataFrame([("Azithromycin",), ("amikacin",)], "drug string")
    got = {(r.sample_id, r.drug): (r.call, r.confidence, r.target_covered) for r in ntm.call_drugs(samples, v, erm, genes, drugs).collect()}
    assert got["a", "Azithromycin"] == ("R", "high", True) and got["a", "amikacin"] == ("no-call", "none", True)
    assert got["b", "Azithromycin"] == ("no-call", "none", True) and got["b", "amikacin"] == ("no-call", "none", False)
    assert got["c", "amikacin"] == ("Uncertain", "low", True) and got["d", "amikacin"] == ("no-call", "none", False)
    sites = spark.createDataFrame([("s", "c", p, 5, 0, 0, 0) for p in range(1, 60)], COUNTS)
    span = spark.createDataFrame([("x", "c", 1, 61), ("y", "c", 1, 121)], "name string, chrom string, start_pos int, end_pos int")
    held = {r.gene: (round(r.body_coverage, 3), r.callable) for r in ntm.gene_coverage(sites, span).collect()}
    assert held == {"x": (0.857, False), "y": (0.429, False)}


def test_screen(spark):
    with pytest.raises(ValueError):
        contamination.screen_informative(None, 0.1)
    with pytest.raises(ValueError):
        contamination.screen_informative("std", 0)
    rows = spark.createDataFrame([("a", 70.0, "S", "Mycobacterium tuberculosis"), ("a", 20.0, "S", "Escherichia coli"), ("b", 0.1, "S", "Escherichia coli")], "sample_id string, percentage double, rank string, name string")
    got = {r.sample_id: (r.largest_foreign, r.status) for r in contamination.screen(rows, "Mycobacterium", True).collect()}
    assert got == {"a": (0.2, "fail"), "b": (0.0, "pass")}
    assert contamination.screen(rows, "Mycobacterium", False).first().largest_foreign is None


def test_text_review(spark):
    answers = [
        ("ok", "The depth was 26.2x over 5,015,531 sites.", "depth 26.24, 5015531 sites"), ("num", "Depth is 180x.", "depth 18"), ("org", "This is M. bovis.", "M. tuberculosis"), ("blank", " ", ""),
        ("set", "The contamination screen came back clean.", ""), ("hedge", "The contamination screen was not informative, so nothing is known.", ""),
        ("sus", "The isolate is susceptible to ethambutol.", ""), ("neg", "Ethambutol is not shown to be sensitive to it.", ""), ("con", "Rifampicin can still be used.", ""), ("val", "The sample is reliable.", ""),
    ]
    facts = [("set", "unmeasured", "contamination"), ("hedge", "unmeasured", "contamination"), ("sus", "no_determinant", "ethambutol"), ("neg", "no_determinant", "ethambutol"), ("con", "resistant", "rifampicin"), ("val", "validity", "invalid")]
    got = {r.answer_id: r.rule for r in A.review(spark.createDataFrame(answers, "answer_id string, answer string, context string"), spark.createDataFrame(facts, "answer_id string, kind string, term string")).collect()}
    assert got == {"ok": None, "num": "unsupported-number", "org": "invented-organism", "blank": "empty", "set": "unmeasured-as-settled", "hedge": None, "sus": "susceptible-for-no-determinant", "neg": None, "con": "contradicts-drug-call", "val": "contradicts-validity"}
    assert values(spark, "x string", [("acgt" * 13,), ("acgt",), (None,)], y=A.looks_like_sequence(F.col("x"))) == [(True,), (False,), (False,)]


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 40


def test_a_barcode_that_grows_is_not_broadcast(spark, monkeypatch):
    """Support without the grid is that of the grid, for samples and positions without sites too."""
    monkeypatch.setattr(L, "SCHEME_ROWS", 3)
    barcode = spark.createDataFrame([("c", p, f"lineage{p % 3}", ["A"] if p % 4 else ["C", "T"], "f" if p % 2 else "") for p in range(1, 40)] + [("c", 5, "lineage1", ["A"], "")], "chrom string, pos int, taxon string, alleles array<string>, family string")
    rows = [(s, "c", p, (p * k) % 40, (p + k) % 7, p % 3, k) for k, s in enumerate(("a", "b", "z"), 1) for p in range(k, 45, k)] + [("far", "d", 1, 9, 0, 0, 0)]
    sites = spark.createDataFrame(rows, COUNTS)
    for platform in ("illumina", "ont"):
        want, got = L.taxon_support(L.genotype_barcode(sites, barcode, platform)), L.barcode_support(sites, barcode, platform)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 12
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    mixture, _ = contamination.lineage_mixture(sites.withColumn("qual", F.lit(30)), barcode.withColumn("allele", F.lit("A")))
    assert "strategy=broadcast" not in plan(mixture)
    # only the taxa and their totals
    assert plan(L.barcode_support(sites, barcode, "illumina")).count("strategy=broadcast") == 1
