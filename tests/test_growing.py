import random

from isolates.operators import cohort
from isolates.streaming import growing


def landed(rng, names, indel_at=None):
    rows = []
    for n in names:
        for a in range(0, 400, 50):
            if rng.random() < 0.85:
                rows.append(("region", n, "c1", None, None, None, None, None, None, None, a, a + rng.randint(20, 50)))
        for pos in rng.sample(range(1, 400), 18) + ([7, 120] if rng.random() < 0.7 else []):
            fraction = rng.choice([0.99, 0.99, 0.5])
            rows.append(("variant", n, "c1", pos, "A", rng.choice("CG"), "g", fraction, fraction > 0.9, ["PASS"], None, None))
    if indel_at:
        rows.append(("variant", names[0], "c1", indel_at, "AT", "A", "g", 0.99, True, ["PASS"], None, None))
    return rows


def test_batches_come_to_what_one_job_gives(spark, tmp_path):
    """Two files: the second has an insertion where older samples have SNPs and brings a sample again; its batch is then run once more."""
    rng = random.Random(3)
    batches = [landed(rng, ["a1", "a2"]), landed(rng, ["b1", "a2"], indel_at=7)]
    mask = spark.createDataFrame([("c1", 100, 130)], "chrom string, start_pos int, end_pos int")
    out = str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, growing.LANDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        growing.grow_cohort(spark, str(tmp_path / "in"), out, str(tmp_path / "cp"), mask, 9, 50, files_per_batch=1).awaitTermination()
    growing.add_batch(spark, spark.createDataFrame(batches[1], growing.LANDED), 1, out, mask, threshold=9, floor=50)
    whole = spark.createDataFrame([r for r in batches[0] if r[1] != "a2"] + batches[1], growing.LANDED)
    variants, regions, samples = cohort.usable_variants(whole.filter("kind = 'variant'")), whole.filter("kind = 'region'"), whole.select("sample_id").distinct()
    pairs, members = growing.cohort_now(spark, out)
    want = cohort.pairwise_distances(variants, regions, mask, samples)
    assert sorted(map(tuple, pairs.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, members.collect()), key=str) == sorted(map(tuple, cohort.cluster_members(samples, want, 9, 50).collect()), key=str)
    assert {r.batch for r in spark.read.parquet(out + "/pairs").select("batch").distinct().collect()} == {0, 1}
