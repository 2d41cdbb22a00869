import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isolates.functions import drugs as D
from isolates.functions import expressions as E
from isolates.operators import intervals, naming, resistance, species, textaudit


def brute_placements(seq, pos, ref, alt, window=24):
    """All indels of one base of anchor within the window that rebuild the same sequence."""
    whole, out, n = seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :], set(), abs(len(ref) - len(alt))
    for p in range(max(1, pos - window), min(len(seq), pos + window) + 1):
        if len(ref) > len(alt):
            if seq[: p] + seq[p + n :] == whole and p + n <= len(seq):
                out.add((p, seq[p - 1 : p + n], seq[p - 1]))
        else:
            block = whole[p : p + n]
            if seq[:p] + block + seq[p:] == whole:
                out.add((p, seq[p - 1], seq[p - 1] + block))
    return out


def test_equivalent_placements(spark):
    seq = "GGCACTACTACTGATTTTTACGAGAGAGC"
    cases = [(4, "ACTA", "A"), (15, "T", "TT"), (14, "AT", "A"), (21, "CGA", "C"), (6, "T", "TGG"), (8, "C", "G"), (2, "AAA", "A"), (24, "A", "AGA")]
    rows = [("S", str(i), "c", p, r, a) for i, (p, r, a) in enumerate(cases)]
    found = naming.equivalent_placements(spark.createDataFrame(rows, "sample_id string, variant_id string, chrom string, pos int, ref string, alt string"), spark.createDataFrame([("c", seq)], "chrom string, seq string"))
    got = {}
    for r in found.collect():
        got.setdefault(int(r.variant_id), set()).add((r.pos, r.ref, r.alt))
    for i, (p, r, a) in enumerate(cases):
        fits = seq[p - 1 : p - 1 + len(r)] == r and len(r) != len(a)
        assert got[i] == (brute_placements(seq, p, r, a) if fits else {(p, r, a)}), cases[i]


def test_comments_and_names(spark):
    rows = [(" PA ", "High-level resistance; additive"), ("rif", "cross-resistance seen"), ("Bedaquiline", "Cross resistance"), (None, None), ("x9", "cross-resistant to kan and AMK, not PMDX")]
    out = spark.createDataFrame(rows, "drug string, comment string").select(
        D.drug_name(F.col("drug")), D.drug_code(F.col("drug")), D.level_stated(F.col("comment")), D.drugs_named(F.col("comment")), D.cross_resistance(F.col("comment"), F.col("drug"))
    )
    assert [tuple(r) for r in out.collect()] == [
        ("pretomanid", "PMD", "additive low-level", [], []), ("rifampicin", "RIF", None, [], []), ("bedaquiline", "BDQ", None, [], ["clofazimine"]), (None, None, None, [], []),
        ("x9", "X9", None, ["amikacin", "kanamycin"], ["amikacin", "kanamycin"]),
    ]


def test_consensus_level_and_caveats(spark):
    calls = spark.createDataFrame(
        [("S1", "v1", "WHO", "bedaquiline", 1, "R", "coordinate", "High-level resistance, cross-resistance"), ("S1", "v2", "flat", "bedaquiline", 2, "R-interim", "hgvs", "Low-level resistance")],
        "sample_id string, variant_id string, catalogue string, drug string, grade int, call string, matched_by string, comment string",
    )
    variants = spark.createDataFrame(
        [("S1", "v1", "c", 5, "A", "AT", "Rv0678", ["PASS"], True), ("S1", "v2", "c", 9, "A", "T", "Rv0678", ["PASS"], False)],
        "sample_id string, variant_id string, chrom string, pos int, ref string, alt string, gene string, filters array<string>, is_major boolean",
    )
    for platform, want in (("illumina", []), ("ont", ["ont-indel", "ont-minor"]), ("fasta", ["assembly"])):
        (r,) = resistance.consensus(resistance.contributions(calls, variants, platform), platform).collect()
        assert (r.level, r.cross_resistance, r.caveats) == ("high-level", ["clofazimine"], want)


def test_long_numbers_and_sequences(spark):
    names = ["S9", "S10", "S" + "1" * 25, "S" + "9" * 24, "S007"]
    keyed = spark.createDataFrame([(n,) for n in names], "n string").orderBy(E.natural_key(F.col("n")))
    assert [r.n for r in keyed.collect()] == ["S007", "S9", "S10", "S" + "9" * 24, "S" + "1" * 25]
    seq = "ACGTTGCANACGT" * 3
    got = {r.hash for r in species.sketches(spark.createDataFrame([("x", seq)], "id string, seq string"), 5, 10_000).collect()}
    mers = {seq[i : i + 5] for i in range(len(seq) - 4)} - {m for m in (seq[i : i + 5] for i in range(len(seq) - 4)) if "N" in m}
    canonical = {min(m, m[::-1].translate(str.maketrans("ACGT", "TGCA"))) for m in mers}
    assert len(got) == len(canonical)
    found = intervals.low_complexity(spark.createDataFrame([("c", "ACGT" * 20 + "AT" * 40 + "CGTA" * 20)], "chrom string, seq string"), 48, 20).collect()
    assert [(r.start_pos, r.end_pos) for r in found] == [(80, 168)] or all(60 <= r.start_pos < r.end_pos <= 180 for r in found) and found


@pytest.mark.parametrize("sentence,broken", [
    ("There is no activity record on file at all, and the isolate is susceptible to rifampicin.", True),
    ("The isolate is not known to be susceptible to rifampicin.", False),
])
def test_negation_governs_the_claim_itself(spark, sentence, broken):
    rows = spark.createDataFrame([(sentence,)], "s string").select((~textaudit.negation_governs(F.col("s"))).alias("x"))
    assert rows.first().x == broken


def test_facts_come_from_result_tables(spark):
    checks = spark.createDataFrame([("s", "mean_depth", True), ("s", "gc_fraction", False), ("t", "ani", None)], "sample_id string, name string, measured boolean")
    calls = spark.createDataFrame(
        [("s", "Rifampicin", "R", True), ("s", "INH", "no-call", None), ("s", "Pyrazinamide", "no-call", False), ("s", "linezolid", "Uncertain", True), ("t", "EMB", "S", True)],
        "sample_id string, drug string, call string, target_covered boolean",
    )
    verdicts = spark.createDataFrame([("s", "suspect")], "sample_id string, verdict string")
    got = {tuple(r) for r in textaudit.facts_of(checks, calls, verdicts).collect()}
    assert got == {
        ("s", "unmeasured", "gc_fraction"), ("t", "unmeasured", "ani"), ("s", "resistant", "Rifampicin"), ("s", "no_determinant", "INH"), ("s", "unevaluable", "Pyrazinamide"),
        ("s", "uncertain", "linezolid"), ("s", "validity", "suspect"),
    }
    said = [("s", "Pyrazinamide is susceptible.", ""), ("t", "EMB is susceptible.", "")]
    facts = textaudit.facts_of(checks, calls, verdicts).withColumnRenamed("sample_id", "answer_id")
    rules = {r.answer_id: r.rule for r in textaudit.review(spark.createDataFrame(said, "answer_id string, answer string, context string"), facts).collect()}
    # a sample with no drug in which nothing was found may not be called susceptible either
    assert rules == {"s": "susceptible-for-no-determinant", "t": "susceptible-for-no-determinant"}


def test_sketches_by_a_loop_over_kmers(spark):
    """Pieces of one id, both strands, other letters, repeats, and k-mers with few copies, against plain loops."""
    rng = random.Random(8)
    flip = str.maketrans("ACGT", "TGCA")

    def mixed(x):
        top = (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return (x ^ x >> 31) >> 1

    def plain(rows, k, size, least):
        held = {}
        for name, seq in rows:
            seq = (seq or "").upper()
            for i in range(len(seq) - k + 1):
                mer = seq[i : i + k]
                if set(mer) <= set("ACGT"):
                    code = min(mer, mer.translate(flip)[::-1])
                    h = mixed(sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(code)))
                    held.setdefault(name, Counter())[h] += 1
        return {(name, h) for name, c in held.items() for h in sorted(x for x, n in c.items() if n >= least)[:size]}

    rows = [(rng.choice("abc"), "".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(0, 120)))) for _ in range(40)]
    rows += [("a", rows[0][1]), ("d", None), ("e", "ACG"), ("f", rows[1][1].upper().translate(flip)[::-1]), ("g", rows[1][1])]
    frame = spark.createDataFrame(rows, "id string, seq string").repartition(4)
    for k, size, least in ((5, 20, 1), (7, 1000, 1), (5, 50, 2), (32, 9, 1)):
        got = [tuple(r) for r in species.sketches(frame, k, size, least).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, k, size, least)
    own = {n: {h for i, h in got if i == n} for n in "fg"}
    assert own["f"] == own["g"]
