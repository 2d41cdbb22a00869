import collections
import zlib

from pyspark.sql import functions as F

from isolates.llm import op3_sharding
from tests.llm.corpus import ODD, SCHEMA


def test_rewrite_of_odd_rows(spark, tmp_path):
    rows = [*ODD, *[(i, "x" * (40 + i), "aa", "s", 0) for i in range(10, 60)], *[(9, "same text", "aa", "s", 0)] * 8]
    docs = spark.createDataFrame(rows, SCHEMA)
    layout = docs.withColumn("shard", F.when(F.col("doc_id") < 40, 0).when(F.col("doc_id").isNotNull(), 1))
    moved = op3_sharding.reshard(layout, F.col("shard"), 2, 3)
    moved = op3_sharding.materialise(moved, "moved")
    changed = op3_sharding.rewrite(layout, moved, str(tmp_path / "out"))
    key = lambda r: (r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)
    want = collections.Counter(key(r) for r in moved.collect() if r.shard in changed)
    written = spark.read.parquet(str(tmp_path / "out"))
    got = collections.Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode()), r.shard, r.slot) for r in written.collect()
    )
    assert changed == [0, 1, 2] and sum(want.values()) == len(rows) and got == want
