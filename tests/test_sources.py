import gzip
import random

import pytest
from pyspark.sql import functions as F

from isolates.operators import annotation, coverage, lineage
from isolates.sources import readers as R
from isolates.sources import sinks
from isolates.sources import views as V
from isolates.streaming.landed import run_landed


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_fastq(spark, tmp_path):
    path = put(tmp_path, "s1.fastq", "@a\nACGT\n+\nIIII\n@b\nAC\n+\n!!\n")
    rows = R.read_fastq(spark, [path]).collect()
    assert [(r.sample_id, r.name, r.seq, r.qual) for r in rows] == [("s1", "a", "ACGT", "IIII"), ("s1", "b", "AC", "!!")]
    profile = coverage.read_profile(R.read_lengths(R.read_fastq(spark, [path]))).first()
    assert (profile.reads, profile.n50, profile.max_length, profile.mean_quality) == (2, 4, 4, 20.0)
    bad = put(tmp_path, "s2.fastq", "@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        R.read_fastq(spark, [bad]).collect()


def records(rng, n, long=False):
    out = []
    for i in range(n):
        k = rng.randint(1, 4000 if long else 150)
        # marks that look like a record's other lines: @ and + begin many of them
        out.append((f"r{i} {'x' * rng.randint(1, 30)}", "".join(rng.choice("ACGTN") for _ in range(k)), rng.choice("@+I!") + "".join(rng.choice("@+I!5") for _ in range(k - 1))))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{n}{end}{s}{end}+{n if i % 3 == 0 else ''}{end}{q}{end}" for i, (n, s, q) in enumerate(rows))


@pytest.mark.parametrize("split,long", [("400b", False), ("90b", False), ("5k", True)])
def test_one_fastq_in_many_splits(spark, tmp_path, split, long):
    """As many tasks as splits, some of them shorter than a record: the same rows as one split gives."""
    rng = random.Random(5)
    rows = {"a": records(rng, 60, long), "b": records(rng, 3, long), "c": []}
    paths = [put(tmp_path, f"{name}.x.fastq", fastq(r)) for name, r in rows.items()]
    with gzip.open(tmp_path / "z.fq.gz", "wt") as out:
        out.write(fastq(rows["a"]))
    paths.append(str(tmp_path / "z.fq.gz"))
    rows["z"] = rows["a"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        frame = R.read_fastq(spark, paths)
        got = sorted((r.sample_id, r.name, r.seq, r.qual) for r in frame.collect())
        assert got == sorted((s, *r) for s, held in rows.items() for r in held)
        assert spark.read.text(paths).rdd.getNumPartitions() > 4
        few = sorted((r.sample_id, r.name) for r in R.read_fastq(spark, paths, max_records=7).collect())
        assert few == sorted((s, r[0]) for s, held in rows.items() for r in held[:7])
        most = 5 * len(rows["a"][0][1])
        want, bases = [], 0
        for r in rows["a"]:
            if bases < most:
                want.append(r[0])
            bases += len(r[1])
        assert sorted(r.name for r in R.read_fastq(spark, paths[:1], max_bases=most).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fastq_that_is_cut_off_or_none(spark, tmp_path):
    cut = put(tmp_path, "s1.fastq", "@a\r\nACGT\r\n+\r\nIIII\r\n@b\r\nAC\r\n+\r\n")
    assert [(r.name, r.seq) for r in R.read_fastq(spark, cut).collect()] == [("a", "ACGT")]
    assert R.read_fastq(spark, put(tmp_path, "s2.fastq", "")).collect() == []
    for text in ("a\nACGT\n+\nIIII\n", "@a\nACGT\nIIII\n@b\n"):
        with pytest.raises(Exception, match="no FASTQ record"):
            R.read_fastq(spark, put(tmp_path, "s3.fastq", text)).collect()


def test_one_fasta_in_many_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    seqs = {f"c{i}": "".join(rng.choice("acgtN") for _ in range(n)) for i, n in enumerate([3000, 0, 1, 61, 900])}
    text = ";comment\n" + "".join(f">{n} of {i}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) + "\n" for i, (n, s) in enumerate(seqs.items()))
    path = put(tmp_path, "g.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = {r.name: (r.header, r.seq) for r in R.read_fasta(spark, path).collect()}
        assert got == {n: (f"{n} of {i}", s.upper()) for i, (n, s) in enumerate(seqs.items())}
        pieces = R.read_fasta_pieces(spark, path)
        for r in pieces.collect():
            assert seqs[r.name].upper()[r["at"] : r["at"] + len(r.bases)] == r.bases
        tiles = annotation.tiles_of_pieces(pieces.select(F.col("name").alias("chrom"), "at", "bases"))
        whole = annotation.sequence_tiles(spark.createDataFrame([(n, s) for n, s in seqs.items()], "chrom string, seq string"))
        assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "g.fa", ">c1 one\nacg\nT\n>c2\n\n")
    rows = R.read_fasta(spark, path).orderBy("name").collect()
    assert [(r.name, r.header, r.seq) for r in rows] == [("c1", "c1 one", "ACGT"), ("c2", "c2", "")]


def test_mpileup(spark, tmp_path):
    path = put(tmp_path, "s1.pileup", "c1\t5\tA\t6\t.,^Tg$*+2ACn\tIIIIII\nc1\t6\tC\t0\t*\t*\nc1\t7\tg\t3\tT-1a.#\tIII\n")
    rows = {r.pos: r for r in R.read_mpileup(spark, path).collect()}
    assert (rows[5].n_a, rows[5].n_g, rows[5].n_gap, rows[5].n_n, rows[5].ins) == (2, 1, 1, 1, {"AC": 1})
    assert not rows[6].covered and rows[6].n_c == 0
    assert (rows[7].n_t, rows[7].n_g, rows[7].n_gap) == (1, 1, 1) and rows[7]["del"] == {"A": 1}


def test_pileup_columns_against_a_walk(spark):
    """A walk over each column, a mark at a time, and the expressions count alike."""
    rng = random.Random(1)

    def walk(text, ref):
        counts, ins, gone, i = dict.fromkeys("ACGTN-", 0), {}, {}, 0
        while i < len(text):
            c = text[i]
            i += 1
            if c == "^":
                i += 1
            elif c in "+-" and text[i : i + 1].isdigit():
                j = i
                while text[j : j + 1].isdigit():
                    j += 1
                word = text[j : j + int(text[i:j])].upper()
                held = ins if c == "+" else gone
                held[word] = held.get(word, 0) + 1
                i = j + int(text[i:j])
            elif c in ".," and ref in counts:
                counts[ref] += 1
            elif c in "*#":
                counts["-"] += 1
            elif c.upper() in "ACGTN":
                counts[c.upper()] += 1
        return *counts.values(), ins, gone

    rows = []
    for _ in range(300):
        text = ""
        for _ in range(rng.randint(0, 30)):
            n = rng.choice([1, 2, 11])
            text += rng.choice([".", ",", "A", "c", "n", "*", "#", "$", "<", ">", "^" + rng.choice("+-^9.A"), f"{rng.choice('+-')}{n}" + "".join(rng.choice("acgtN") for _ in range(n)), "+"])
        rows.append((text.replace("+.", "."), rng.choice("ACGTR")))
    frame = spark.createDataFrame(rows, "bases string, ref string")
    counts = R.pileup_counts(F.col("bases"), F.col("ref"))
    got = frame.select("bases", "ref", *[c.alias(n) for n, c in counts.items()]).collect()
    assert [tuple(r)[2:] for r in got] == [walk(r.bases, r.ref) for r in got]


def test_vcf_of_several_samples(spark, tmp_path):
    head = '##fileformat=VCFv4.2\n##contig=<ID=c1,length=9>\n##contig=<ID=c2>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n'
    many = ":".join(f"F{i}" for i in range(60))
    text = head + f"c1\t5\t.\tA\tC,G\t9\tPASS\tDP=40\tGT:AD:{many}\t0/1:10,5,5\t1/2:0,8\nc2\t7\t.\tT\tA\t.\t.\tAO=1\tGT:DP:AD\t1:9:4\t.\nc2\tx\n"
    path = put(tmp_path, "cohort.vcf", text)
    got = {(r.sample_id, r.pos, r.alt): (r.depth, r.ref_reads, r.alt_reads, r.allele_fraction) for r in R.read_vcf(spark, path).collect()}
    assert got == {
        ("x", 5, "C"): (40, 10, 5, 0.25), ("x", 5, "G"): (40, 10, 5, 0.25), ("y", 5, "C"): (40, None, None, None), ("y", 5, "G"): (40, None, None, None),
        ("x", 7, "A"): (9, None, 4, 4 / 9), ("y", 7, "A"): (None, None, 1, None),
    }
    (header,) = R.read_vcf_headers(spark, path).collect()
    assert (header.samples, header.contigs) == (["x", "y"], ["c1", "c2"])
    graded = put(tmp_path, "w.vcf", "#CHROM\nc1\t5\t.\ta\tc\t.\t.\tX=1;graded_variant=rpoB_p.A & g_LoF\nc1\t6\t.\ta\tc\t.\t.\tother_graded_variant=z\n")
    assert sorted(map(tuple, R.read_catalogue_coordinates_vcf(spark, graded).collect())) == [("g_LoF", "c1", 5, "A", "C"), ("rpoB_p.A", "c1", 5, "A", "C")]


def test_vcf(spark, tmp_path):
    path = put(
        tmp_path,
        "s1.vcf",
        "##x\n#CHROM\nc1\t10\t.\tA\tC,<*>\t50\tPASS\tDP=20\tGT:AD\t1:5,15,0\nc1\t11\t.\tAT\tA\t.\tlow;q\tAO=3;RO=9\tGT\t1\nc1\t12\t.\tG\tT\t9\t.\tAF=0.25;DP=8\n",
    )
    rows = {r.pos: r for r in R.read_vcf(spark, path).collect()}
    assert len(rows) == 3 and (rows[10].alt, rows[10].depth, rows[10].alt_reads, rows[10].allele_fraction) == ("C", 20, 15, 0.75)
    assert (rows[11].variant_type, rows[11].filters, rows[11].allele_fraction) == ("deletion", ["low", "q"], 0.25)
    assert rows[12].allele_fraction == 0.25 and rows[12].filters == ["PASS"] and rows[12].alt_reads is None


def test_small_formats(spark, tmp_path):
    bed = put(tmp_path, "m.bed", "c1\t0\t5\nc1\t9\t12\n")
    assert R.read_bed(spark, bed).count() == 2
    with pytest.raises(Exception, match="empty, reversed"):
        R.read_bed(spark, put(tmp_path, "bad.bed", "c1\t5\t5\n")).collect()
    barcode = R.read_barcode(spark, put(tmp_path, "b.bed", "c1\t9\t10\tlineage1\tR\tIndo\tNone\tRD239\n")).first()
    assert (barcode.pos, barcode.alleles, barcode.family, barcode.spoligotype, barcode.rd) == (10, ["A", "G"], "Indo", "", "RD239")
    gff = "##gff\nc1\tx\tgene\t1\t90\t.\t+\t.\tID=g1;locus_tag=Rv1;Name=Rv1\nc1\tx\tgene\t100\t200\t.\t-\t.\tID=g2;locus_tag=Rv2;gene=abc\nc1\tx\tgene\t300\t400\t.\t+\t.\tID=g3;locus_tag=Rv3\nc1\tx\trRNA\t300\t400\t.\t+\t.\tID=r;Parent=g3;product=16S ribosomal RNA\n"
    assert {r.name for r in R.read_gff(spark, put(tmp_path, "g.gff", gff)).collect()} == {"Rv1", "abc", "rrs"}
    depth = R.read_depth(spark, put(tmp_path, "s1.depth", "c1\t1\t5\nbroken\nc1\t2\tx\n"))
    assert [tuple(r) for r in depth.collect()] == [("s1", "c1", 1, 5)]
    stats = R.read_library_stats(spark, put(tmp_path, "s1.stats", "SN\traw total sequences:\t10\nSN\treads mapped:\t9\nGCF\t40\t1\nGCL\t60\t3\n")).first()
    assert (stats.reads, stats.mapped, stats.duplicates, round(stats.gc, 6)) == (10, 9, None, 0.55)
    report = R.read_classifier_report(spark, put(tmp_path, "s1.report", " 60.5\t10\t1\tS\t1773\t  M. tuberculosis\nbad\n")).collect()
    assert [r.malformed for r in report] == [False, True] and report[0].name == "M. tuberculosis"
    paf = put(tmp_path, "x.paf", "c1\t999\t0\t300\t+\tc1\t999\t0\t300\t300\t300\nc1\t999\t0\t300\t+\tc1\t999\t500\t800\t290\t300\nc1\t9\t0\t50\t+\tc1\t9\t60\t99\t50\t50\n")
    assert sorted(tuple(r) for r in R.read_paf_repeats(spark, paf).collect()) == [("c1", 0, 300), ("c1", 500, 800)]
    assert R.read_fai(spark, put(tmp_path, "g.fai", "c1\t500\t1\t2\t3\n")).first().length == 500
    ani = R.read_ani(spark, put(tmp_path, "s1.mash", "ref.fa\ts1\t0.05\t0\t5/10\n"), "mash").first()
    assert round(ani.ani, 6) == 95.0 and ani.aligned_fraction is None
    assert len(R.provenance(spark, bed).first().sha256) == 64
    third = R.read_third_catalogue(spark, put(tmp_path, "t.csv", "gene,mutation,drug,confidence,type,comment\nrpoB,p.Ser450Leu,RIF,1) Assoc w R,drug_resistance,\ngyrA,p.A,Moxi,,drug_resistance,\nx,p.B,Moxi,1) guessed,other,\n"))
    assert [(r.drug, r.call, r.grade) for r in third.orderBy("gene").collect()] == [("moxi", "R", None), ("rifampicin", "R", 1), ("moxi", "Uncertain", None)]


def test_catalogues(spark, tmp_path):
    head = "title\t\n\t\ndrug\tgene\tmutation\tvariant\ttier\tposition\tFINAL CONFIDENCE GRADING\tComment\tAdditional grading criteria applied\n"
    path = put(tmp_path, "graded.tsv", head + "Rifampicin\trpoB\tp.Ser450Leu\trpoB_p.Ser450Leu\t1\t7\t1) Assoc w R\tx\t\nIsoniazid\tkatG\tLoF\tkatG_LoF\t1\t\t2) Assoc w R - Interim\t\tgraded by rule\n")
    rows = {r.drug: r for r in R.read_graded_catalogue(spark, path).collect()}
    assert (rows["rifampicin"].grade, rows["rifampicin"].call, rows["rifampicin"].rule_only) == (1, "R", False)
    assert (rows["isoniazid"].call, rows["isoniazid"].rule_only) == ("R-interim", True)
    flat = put(tmp_path, "flat.tsv", "position\tref\talt\tgene\tchange\tdrugs\tremark\n7\ta\tg\tgyrA\tA90V\tFluoroquinolones (FQ)\t\n9\tac\ta\tpncA\tdel\tPyrazinamide\t\n3\ta\tc\tx\ty\tIsoniazid\tphylogenetic SNP\n")
    got = sorted((r.drug, r.pos, r.alt, r.call) for r in R.read_flat_catalogue(spark, flat).collect() if r.drug != "pyrazinamide")
    assert got == [("levofloxacin", 7, "G", "R"), ("moxifloxacin", 7, "G", "R")]
    manifest = R.read_reference_manifest(spark, put(tmp_path, "m.tsv", "#c\nreference\tname\taccession\tcomplex\n/db/avium.fna.gz\tM. avium\tGCF_1\tMAC\n"))
    matches = spark.createDataFrame([("s", "/other/avium.fna"), ("s", "gcf_1"), ("s", "none")], "sample_id string, reference string")
    found = {r.reference: r.name for r in R.resolve_references(matches, manifest).collect()}
    assert found == {"/other/avium.fna": "M. avium", "gcf_1": "M. avium", "none": None}
    with pytest.raises(ValueError, match="no column"):
        R.read_reference_manifest(spark, put(tmp_path, "n.tsv", "a\tb\n1\t2\n"))


def test_pairs(spark):
    files = spark.createDataFrame([("/d/x_S1_L001_R1_001.fastq.gz",), ("/d/x_S1_L001_R2_001.fastq.gz",), ("/d/y_1.fq",), ("/d/z.fastq",)], "path string")
    rows = {r.sample_id: (r.r1, r.r2) for r in R.pair_reads(files).collect()}
    assert rows == {"x": ("/d/x_S1_L001_R1_001.fastq.gz", "/d/x_S1_L001_R2_001.fastq.gz"), "y_1": ("/d/y_1.fq", None), "z": ("/d/z.fastq", None)}
    lanes = spark.createDataFrame([("/d/x_L001_R1.fastq",), ("/d/x_L002_R1.fastq",)], "path string")
    with pytest.raises(Exception, match="merge its lanes"):
        R.pair_reads(lanes).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", ["a", "b"], None)], "sample_id string, x array<string>, y int").coalesce(1)
    sinks.write_tsv(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert text == "sample_id\tx\ty\ns1\ta;b\tNA\n"
    sinks.write_tsv(df.filter("false"), str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("part*")).strip() == "sample_id\tx\ty"
    nested = sinks.sample_json(spark.createDataFrame([("s1",), ("s2",)], "sample_id string"), parts=df.select("sample_id", "y"))
    sinks.write_json(nested, str(tmp_path / "j"))
    back = R.read_results(spark, str(tmp_path / "j"), "sample_id string, parts array<struct<y:int>>, other int").orderBy("sample_id").collect()
    assert len(back[0].parts) == 1 and back[1].parts == []
    joint = spark.createDataFrame([("c", 1, "A", "s1", "T"), ("c", 1, "A", "s2", "?")], "chrom string, pos int, ref string, sample_id string, allele string")
    assert tuple(sinks.joint_wide(joint, ["s1", "s2"]).first()) == ("c", 1, "A", "T", "?")


def test_landed_equals_batch(spark, tmp_path):
    schema = "sample_id string, chrom string, pos int, depth int"
    for i in range(3):
        spark.createDataFrame([(f"S{i}", "c1", p, p % 7 + i) for p in range(40)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step = {"regions": lambda b: coverage.callable_regions(b, 4)}
    q = run_landed(spark, str(tmp_path / "in"), schema, step, str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=1)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "regions")).drop("batch")
    want = coverage.callable_regions(spark.read.schema(schema).parquet(str(tmp_path / "in")), 4)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_all_views_in_one_write(spark, tmp_path):
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    drugs = spark.createDataFrame([("s1", "b", 2, 0.5, True, ["x", None]), ("s1", "a", 10, 3.0, False, []), ("s2", "a\tb\nc", -1, float("nan"), None, None), ("other", "a", 1, 1.0, True, [])], "sample_id string, drug string, place int, share double, seen boolean, names array<string>")
    calls = {"drugs": drugs, "tools": spark.createDataFrame([("caller", "1.2")], "tool string, version string"), "disagreements": drugs.filter("false").select("sample_id", "drug")}
    pairs = spark.createDataFrame([("s1", "s2", 12, None)], "sample_a string, sample_b string, snps long, note string")
    root = str(tmp_path / "run")
    counts = V.write_run(root, samples, calls, {"distances": pairs}, {"drugs": ["place"]})
    assert counts["drugs"] == 3 and counts["tools"] == 3 and counts["distances"] == 1 and counts["checks"] == 0 and counts["disagreements"] == 0
    text = lambda view, sample: "".join(p.read_text() for p in (tmp_path / "run" / f"view={view}" / f"sample_id={sample}").glob("part*"))
    head = "sample_id\tdrug\tplace\tshare\tseen\tnames\n"
    assert text("drugs", "s1") == head + "s1\tb\t2\t0.5\tyes\tx;NA\n" + "s1\ta\t10\t3\tno\t\n"
    assert text("drugs", "s2") == head + "s2\ta b c\t-1\tNA\tNA\tNA\n" and text("drugs", "s3") == head
    assert text("disagreements", "s2") == "sample_id\tdrug\n" and text("tools", "s3") == "sample_id\ttool\tversion\ns3\tcaller\t1.2\n"
    assert text("distances", "cohort") == "sample_id\tsample_a\tsample_b\tsnps\tnote\ncohort\ts1\ts2\t12\tNA\n"
    for name in V.SAMPLE_VIEWS:
        files = list((tmp_path / "run" / f"view={name}").glob("sample_id=s*/part*"))
        assert len(files) == 3 and all(f.read_text().startswith("sample_id") for f in files)
    assert V.write_run(root, samples.filter("sample_id = 's1'"), calls)["drugs"] == 2 and not text("drugs", "s2")
    with pytest.raises(ValueError, match="no view is named"):
        V.all_lines({"drug": drugs}, samples)
    with pytest.raises(ValueError, match="no results"):
        V.write_run(root, samples.limit(0), calls)
