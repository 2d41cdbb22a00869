"""A cohort that grows: every micro-batch compares its samples with all, and clusters are merged, not made anew.

State lies in folders by batch, so a batch that is run again replaces what it wrote and reads only what earlier batches
wrote: variants and regions as they landed, the pairs that a batch computed, the spanning forest and the members after it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isolates.functions.thresholds import VALUE
from isolates.operators import cohort as H
from isolates.session import ship_package

VARIANT = ["sample_id", "chrom", "pos", "ref", "alt", "gene", "allele_fraction", "is_major", "filters", "is_snp"]
REGION = ["sample_id", "chrom", "start_pos", "end_pos"]
#: What lands: variants and callable regions of whole samples in one table, told apart by ``kind``.
LANDED = (
    "kind string, sample_id string, chrom string, pos int, ref string, alt string, gene string, allele_fraction double, is_major boolean, filters array<string>, start_pos int, end_pos int"
)


def _state(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """What batches before ``before`` wrote, with their ``batch``; None if there is nothing."""
    try:
        held = spark.read.parquet(folder)
    except AnalysisException:
        return None
    return held.filter(F.col("batch") < before)


def latest_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair as the last batch that computed it has it."""
    rest = [c for c in pairs.columns if c not in ("sample_a", "sample_b", "batch")]
    return pairs.groupBy("sample_a", "sample_b").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("sample_a", "sample_b", "x.*")


def add_batch(spark: SparkSession, batch: DataFrame, number: int, out: str, mask: DataFrame, threshold: int = int(VALUE["cluster_default"]), floor: int = int(VALUE["min_shared_callable"])) -> None:
    """Add the samples of ``batch`` (columns of ``LANDED``) to the cohort under ``out`` as batch ``number``.

    New pairs are those of new samples with all. Pairs of samples that stand at a site which a new sample turned into
    something else than a SNP are computed again. The forest of before and the new links together give the forest
    of now; only where old pairs changed it is made from all pairs. A sample that lands again replaces itself.
    """
    rows = H.usable_variants(batch.filter("kind = 'variant'"))
    regions = batch.filter("kind = 'region'").select(*REGION)
    written = {"variants": rows.select(*VARIANT), "regions": regions, "samples": batch.select("sample_id").distinct()}
    for name, df in written.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    now = {n: spark.read.parquet(f"{out}/{n}/batch={number}") for n in written}
    old = {n: _state(spark, f"{out}/{n}", number) for n in written}
    fresh, every = now["samples"], {}
    for name in written:
        columns = now[name].columns
        # a sample that landed again counts as it is now
        kept = old[name].select("batch", *columns).join(now["samples"], "sample_id", "left_anti").select(*columns) if old[name] is not None else None
        every[name] = now[name] if kept is None else kept.unionByName(now[name])
    changed = None
    if old["variants"] is not None:
        before = old["variants"].select(*VARIANT)
        changed = H.departing_at_changed_sites(before, every["variants"]).join(fresh, "sample_id", "left_anti")
        again = old["samples"].join(fresh, "sample_id", "left_semi")
        fresh = fresh.unionByName(changed).distinct()
        changed = changed.unionByName(again.select("sample_id"))
    H.pairwise_distances(every["variants"], every["regions"], mask, every["samples"], fresh=fresh).write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")
    new = spark.read.parquet(f"{out}/pairs/batch={number}")
    links = lambda pairs: H.comparable_pairs(pairs, floor).filter("state = 'comparable'").select("sample_a", "sample_b", "snps")
    earlier = _state(spark, f"{out}/forest", number)
    if earlier is None or (changed is not None and not changed.isEmpty()):
        held = _state(spark, f"{out}/pairs", number + 1)
        edges = links(latest_pairs(held))
    else:
        last = earlier.agg(F.max("batch")).first()[0]
        edges = links(new).unionByName(earlier.filter(F.col("batch") == (last if last is not None else -1)).select("sample_a", "sample_b", "snps"))
    H.minimum_spanning_forest(edges).write.mode("overwrite").parquet(f"{out}/forest/batch={number}")
    forest = spark.read.parquet(f"{out}/forest/batch={number}").withColumn("shared_callable_sites", F.lit(floor))
    H.cluster_members(every["samples"], forest, threshold, floor).write.mode("overwrite").parquet(f"{out}/members/batch={number}")


def grow_cohort(spark: SparkSession, source: str, out: str, checkpoint: str, mask: DataFrame, threshold: int = int(VALUE["cluster_default"]), floor: int = int(VALUE["min_shared_callable"]), files_per_batch: int = 100) -> StreamingQuery:
    """Start a query that adds the samples of Parquet files (columns of ``LANDED``, a sample in one file) as they land."""
    ship_package(spark)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            add_batch(batch.sparkSession, batch, number, out, mask, threshold, floor)

    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cohort_now(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the cohort after its last batch."""
    members = spark.read.parquet(f"{out}/members")
    last = members.agg(F.max("batch")).first()[0]
    return latest_pairs(spark.read.parquet(f"{out}/pairs")), members.filter(F.col("batch") == last).drop("batch")
