import random

import pytest

from isolates.operators import annotation as A

CODONS = {"M": "ATG", "D": "GAC", "R": "CGT", "K": "AAA", "L": "CTG", "A": "GCT", "*": "TAA", "S": "TCA", "G": "GGC"}
rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(protein):
    return "".join(CODONS[x] for x in protein)


@pytest.fixture(scope="module")
def genome():
    """One contig: geneA forward, geneB backward, an rRNA gene, and filler between them."""
    rng = random.Random(3)
    filler = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = dna("MDRKKKLAASGD*"), dna("MAGDSLKR*")
    seq, spans = filler(1000) + "T", {}
    for name, part, strand, kind in (("geneA", a, "+", "protein_coding"), ("geneB", rc(b), "-", "protein_coding"), ("rrx", filler(60), "+", "rRNA")):
        spans[name] = (len(seq) + 1, len(seq) + len(part), strand, kind)
        seq += part + filler(40)
    return seq, spans


@pytest.fixture(scope="module")
def frames(spark, genome):
    seq, spans = genome
    genes = spark.createDataFrame([("chr1", n, f"t_{n}", *v) for n, v in spans.items()], "chrom string, name string, locus_tag string, start_pos int, end_pos int, strand string, biotype string")
    return genes, A.sequence_tiles(spark.createDataFrame([("chr1", seq), ("chr2", "ACGT" * 700), ("none", None)], "chrom string, seq string"))


def variants(spark, rows, chrom="chr1"):
    return spark.createDataFrame([(f"s{i % 2}", f"v{i}", chrom, *r) for i, r in enumerate(rows)], "sample_id string, variant_id string, chrom string, pos int, ref string, alt string")


def test_tiles_hold_the_contig_with_margins(frames, genome):
    seq, _ = genome
    rows = {(r.chrom, r.tile): r for r in frames[1].collect()}
    assert {c for c, _ in rows} == {"chr1", "chr2"}
    for (chrom, tile), r in rows.items():
        whole = seq if chrom == "chr1" else "ACGT" * 700
        low, high = max(0, tile * A.TILE - A.MARGIN), min(len(whole), (tile + 1) * A.TILE + A.MARGIN)
        assert r.first_pos == low + 1 and r.bases == whole[low:high]


def test_one_name_for_each_kind(spark, frames, genome):
    seq, spans = genome
    a, b, r = spans["geneA"][0], spans["geneB"][1], spans["rrx"][0]
    base = lambda p: seq[p - 1]
    rows = {
        "asp2ala": (a + 4, "A", "C"), "silent": (a + 5, "C", "T"), "start": (a + 2, "G", "T"), "promoter": (a - 5, base(a - 5), "N"), "stop": (a + 3, "GAC", "TGA"),
        "back": (b, "T", "C"), "rrna": (r + 10, base(r + 10), "N"), "shift": (a + 4, "A", "AG"), "across": (a - 3, seq[a - 4 : a + 2], base(a - 3)), "far": (a - 900, base(a - 900), "N"),
        "del": (a + 8, seq[a + 7 : a + 11], base(a + 8)), "same": (a + 3, "GA", "GA"), "pair": (a + 3, "GA", "CC"),
    }
    named = A.annotate(variants(spark, rows.values()), *frames, upstream=100)
    got = dict(zip(rows, [(r.gene, r.hgvs, r.effect) for r in sorted(named.collect(), key=lambda r: int(r.variant_id[1:]))]))
    assert got["asp2ala"] == ("geneA", "p.Asp2Ala", "missense_variant")
    assert got["silent"] == ("geneA", "c.6C>T", "synonymous_variant")
    assert got["start"] == ("geneA", "c.3G>T", "start_lost")
    assert got["promoter"][1].startswith("c.-5") and got["promoter"][2] == "upstream_variant"
    assert got["stop"] == ("geneA", "p.Asp2Ter", "stop_gained")
    assert got["back"] == ("geneB", "c.1A>G", "start_lost")
    assert got["rrna"][:2] == ("rrx", f"n.11{base(r + 10)}>N") and got["rrna"][2] == "non_coding_variant"
    assert got["shift"] == ("geneA", "p.Xaa2fs", "frameshift_variant")
    assert got["across"] == ("geneA", f"c.-2_3del{seq[a - 3 : a + 2]}", "start_lost")
    assert got["far"] == (None, None, "intergenic_variant")
    assert got["del"] == ("geneA", f"c.10_12del{seq[a + 8 : a + 11]}", "inframe_deletion")
    assert got["same"] == (None, None, "no_change")
    assert got["pair"] == ("geneA", "p.Asp2Pro", "missense_variant")


def test_named_rows_stay_and_alleles_are_named_for_all_samples(spark, frames, genome):
    a = genome[1]["geneA"][0]
    rows = [("s1", "chr1", a + 4, "A", "C", "elsewhere", "p.Xxx1Yyy", "own"), ("s2", "chr1", a + 4, "A", "C", None, "", "kept"), ("s3", "chr1", 5, "A", "C", None, None, "kept"), ("s4", "chr9", 5, "A", "C", "", None, None)]
    frame = spark.createDataFrame(rows, "sample_id string, chrom string, pos int, ref string, alt string, gene string, hgvs string, effect string")
    got = {r.sample_id: (r.gene, r.locus_tag, r.hgvs, r.effect) for r in A.annotate(frame, *frames, upstream=100).collect()}
    assert got == {"s1": ("elsewhere", None, "p.Xxx1Yyy", "own"), "s2": ("geneA", "t_geneA", "p.Asp2Ala", "missense_variant"), "s3": (None, None, None, "kept"), "s4": ("", None, None, "intergenic_variant")}
    assert A.annotate(frame.limit(0), *frames).columns == [*frame.columns, "locus_tag"]


def names(spark, frames, rows):
    out = {r: set() for r in rows}
    for r in A.legitimate_names(variants(spark, rows), *frames, upstream=100).collect():
        out[r.pos, r.ref, r.alt].add(f"{r.gene}_{r.name}")
    return out


def test_every_name_of_a_variant(spark, frames, genome):
    seq, spans = genome
    a, r = spans["geneA"][0], spans["rrx"][0]
    base = lambda p: seq[p - 1]
    codon = (a + 11, seq[a + 10 : a + 14], base(a + 11))  # the third base of codon 4 and all of codon 5 but its last
    lys = (a + 8, seq[a + 7 : a + 11], base(a + 8))  # one of three codons AAA goes
    start, pair, shift, stop = (a + 2, "G", "T"), (a + 3, "GA", "CC"), (a + 4, "A", "AG"), (a + 3, "GAC", "TAA")
    into = (a, seq[a - 1 : a + 6], base(a))
    rows = [start, pair, shift, stop, codon, lys, into, (r + 10, base(r + 10), "N"), (a + 1, "T", "TATG")]
    got = names(spark, frames, rows)
    assert {"geneA_c.3G>T", "geneA_LoF"} <= got[start]
    assert {"geneA_p.Asp2Pro", "geneA_c.4_5delGAinsCC", "geneA_p.Asp2His", "geneA_p.Asp2Ala"} <= got[pair] and "geneA_LoF" not in got[pair]
    assert not any("ins" in n and "del" not in n for n in got[pair])
    assert {"geneA_LoF", "geneA_p.Asp2fs"} & got[shift] and "geneA_LoF" in got[shift]
    assert {"geneA_p.Asp2Ter", "geneA_LoF"} <= got[stop]
    # the residue that goes is the last of the three, wherever the bases were taken from
    assert "geneA_p.Lys6del" in got[lys] and "geneA_LoF" in got[lys]
    assert {f"geneA_c.{10 + k}_{12 + k}delAAA" for k in range(7)} <= got[lys]
    assert "geneA_LoF" in got[into] and any(n.startswith("rrx_n.11") for n in got[rows[7]])


def changed(protein, new):
    """How a product's in-frame change is called, by trying all places from the end on."""
    three = lambda i: A.E.THREE[protein[i]] + str(i + 1)
    if len(new) < len(protein):
        n = len(protein) - len(new)
        for i in range(len(protein) - n, -1, -1):
            if protein[:i] + protein[i + n :] == new:
                return f"p.{three(i)}del" if n == 1 else f"p.{three(i)}_{three(i + n - 1)}del"
    return None


def test_residues_deleted_inserted_and_doubled(spark):
    protein = "MDRKKKLAASGDGDSA*"
    cds = dna(protein)
    genes = spark.createDataFrame([("c", "g", 3, 2 + len(cds), "+"), ("r", "g", 3, 2 + len(cds), "-")], "chrom string, name string, start_pos int, end_pos int, strand string")
    tiles = A.sequence_tiles(spark.createDataFrame([("c", "GG" + cds + "CCC"), ("r", "GG" + rc(cds) + "CCC")], "chrom string, seq string"))
    coding = A.coding_sequences(genes, tiles)
    assert {(r.chrom, r.protein) for r in coding.collect()} == {("c", protein), ("r", protein)}
    rows = []
    for i in range(1, len(protein) - 1):
        for n in (1, 2, 3):
            if i + n < len(protein):
                p = 3 + 3 * i - 1  # the anchor, the base before the codon
                rows.append(("c", p, ("GG" + cds)[p - 1 : p + 3 * n], ("GG" + cds)[p - 1], changed(protein, protein[:i] + protein[i + n :])))
        p = 3 + 3 * i - 1
        anchor = ("GG" + cds)[p - 1]
        rows.append(("c", p, anchor, anchor + CODONS[protein[i]], None))
    frame = spark.createDataFrame([(c, p, r, a, "g", 3, "+") for c, p, r, a, _ in rows], "chrom string, pos int, ref string, alt string, gene string, start_pos int, strand string")
    got = {(r.pos, r.ref, r.alt): (r.protein, r.frameshift) for r in A.protein_changes(frame, coding).collect()}
    for _, p, r, a, want in rows:
        if want:
            assert got[p, r, a][0] == want and got[p, r, a][1].endswith("fs")
    at = lambda i: 3 + 3 * i - 1
    insert = lambda i, new: got[at(i), ("GG" + cds)[at(i) - 1], ("GG" + cds)[at(i) - 1] + new]
    assert insert(3, "AAA") == insert(5, "AAA") == ("p.Lys6dup", None) and insert(7, "GCT") == ("p.Ala9dup", None)
    # codons of two residues, the second time the tail of another one, and one that stands nowhere near
    more = [(at(12), "GGCGAC"), (at(3), "TCA"), (at(1), "TAA"), (at(2), "G")]
    frame = spark.createDataFrame([("c", p, ("GG" + cds)[p - 1], ("GG" + cds)[p - 1] + x, "g", 3, "+") for p, x in more], frame.schema)
    got = {r.pos: (r.protein, r.frameshift) for r in A.protein_changes(frame, coding).collect()}
    assert got == {at(12): ("p.Gly13_Asp14dup", None), at(3): ("p.Arg3_Lys4insSer", None), at(1): ("p.Met1_Asp2insTer", None), at(2): (None, "p.Arg3fs")}
    # the same on the other strand: the last of the three lysines goes
    low = 2 + len(cds) - 3 * 4 + 1
    back = spark.createDataFrame([("r", low - 1, ("GG" + rc(cds))[low - 2 : low + 2], ("GG" + rc(cds))[low - 2], "g", 3, "-"), ("r", 9, "TTTTT", "T", "g", 3, "-")], frame.schema)
    (one,) = A.protein_changes(back, coding).collect()
    assert one.protein == "p.Lys6del"


def altered(seq, pos, ref, alt):
    return seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]


def test_alignment_and_placements_by_brute_force(spark, monkeypatch):
    """Against all anchors of the contig, in a repetitive sequence, with tiles and margins far smaller than its repeats."""
    monkeypatch.setattr(A, "TILE", 16)
    monkeypatch.setattr(A, "MARGIN", 8)
    rng = random.Random(7)
    seq = "".join(rng.choice(["A", "AC", "ACT", "GGT", "C", "ACACAC", "T" * 9, "GA" * 12]) for _ in range(60)) + "A" * 150 + "CG" + "ACGTA" * 40 + "GATTACA"
    rows = []
    for _ in range(140):
        pos, n = rng.randrange(1, len(seq) - 40), rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 10, 12, 24, 33])
        if rng.random() < 0.5:
            rows.append((pos, seq[pos - 1 : pos + n], seq[pos - 1]))
        else:
            copy = seq[pos : pos + n] if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(n))
            rows.append((pos, seq[pos - 1], seq[pos - 1] + copy))
    tail = len(seq) - 7
    rows += [(tail - 5, seq[tail - 6 : tail - 1][:5] + seq[tail - 1], seq[tail - 6]), (tail - 210, seq[tail - 211], seq[tail - 211] + "A"), (1, seq[:3], seq[0]), (5, "N" * 4, "N"), (3, seq[2:6].lower(), seq[2])]
    rows = list(dict.fromkeys(rows))
    tiles = A.sequence_tiles(spark.createDataFrame([("c", seq)], "chrom string, seq string"))
    frame = variants(spark, rows, "c")
    got = {(r.pos, r.ref, r.alt): r for r in A.left_aligned_alleles(frame, tiles).collect()}
    placed = {}
    for r in A.placements(frame, tiles, window=6).collect():
        placed.setdefault((r.pos, r.ref, r.alt), set()).add((r.at_pos, r.at_ref, r.at_alt))
    for pos, ref, alt in rows:
        r = got[pos, ref, alt]
        if ref.startswith("N"):
            assert (r.new_pos, r.new_ref, r.new_alt, r.aligned) == (pos, ref, alt, False)
            assert placed[pos, ref, alt] == {(pos, ref, alt)}
            continue
        ref, alt, own = ref.upper(), alt.upper(), (pos, ref, alt)
        want, n = altered(seq, pos, ref, alt), len(ref) - len(alt)
        every = set()
        for p in range(1, len(seq) + 1):
            anchor = seq[p - 1]
            if n > 0 and p + n <= len(seq):
                one = (p, seq[p - 1 : p + n], anchor)
            elif n < 0:
                one = (p, anchor, want[p - 1 : p - n])
            else:
                continue
            if one[1][0] == one[2][0] and altered(seq, *one) == want:
                every.add(one)
        assert (r.new_pos, r.new_ref, r.new_alt) == min(every) and r.aligned, own
        assert placed[r.pos, r.ref, r.alt] == {x for x in every if abs(x[0] - pos) <= 6}, own
    # without a reference only what could not have moved is aligned
    bare = A.normalise_variants(variants(spark, [(5, "CA", "C"), (9, "AA", "A"), (7, "C", "G"), (8, "CAG", "CTG")], "x"), tiles)
    assert sorted((r.pos, r.ref, r.alt, r.filters) for r in bare.collect()) == [(5, "CA", "C", []), (7, "C", "G", []), (9, "A", "T", []), (9, "AA", "A", ["not-left-aligned"])]


def test_genes_that_a_deletion_touches(spark, frames, genome):
    seq, spans = genome
    a, end, b = spans["geneA"][0], spans["geneA"][1], spans["geneB"][0]
    rows = [(a - 3, seq[a - 4 : end + 2], seq[a - 4]), (end - 2, seq[end - 3 : b + 4], seq[end - 3]), (a - 1, "T", "TA")]
    got = {(r.pos, r.gene): (r.lost_bases, r.whole) for r in A.genes_touched(variants(spark, rows), frames[0]).collect()}
    assert got == {(a - 3, "geneA"): (end - a + 1, True), (end - 2, "geneA"): (2, False), (end - 2, "geneB"): (5, False)}


def test_names_are_not_made_again_in_filters_nor_for_each_placement(spark, frames, genome):
    seq, spans = genome
    a = spans["geneA"][0]
    lys = (a + 8, seq[a + 7 : a + 11], seq[a + 7])  # one of three codons AAA goes, so it stands in several places
    rows = variants(spark, [lys, (a + 4, "A", "C")])
    out = A.legitimate_names(rows, *frames, upstream=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "Xaa" in line]
    placed = A.placements(rows.select(*A.ALLELE), frames[1]).filter("length(ref) <> length(alt)")
    own = [A.F.col(c).alias(f"own_{c}") for c in ("pos", "ref", "alt")]
    placed = placed.select("chrom", *own, A.F.col("at_pos").alias("pos"), A.F.col("at_ref").alias("ref"), A.F.col("at_alt").alias("alt"))
    met = A.gene_pairs(placed, frames[0], upstream=100).filter("gene = 'geneA'")
    coding = A.coding_sequences(*frames)
    assert met.count() > 1 and A._one_placement(met).count() == 1
    assert {r.protein for r in A.protein_changes(met, coding).collect()} == {r.protein for r in A.protein_changes(A._one_placement(met), coding).collect()} == {"p.Lys6del"}
