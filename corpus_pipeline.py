"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; what it returns is written and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.near_texts import without_near_duplicates
from isolates.llm.op1_toxicity import without_toxic
from isolates.llm.op2_wumanber import without_contaminated
from isolates.llm.op5_chunks import cut_passages, repeated_passages
from isolates.llm.op6_packing import pack_documents
from isolates.llm.text import crc_mod
from isolates.session import discard_since, materialise, read_table, ship_package, tables_written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator's query calls toxic go. The fit sees the labelled rows that the operator's query may see."""
    ship_package(spark)
    return without_toxic(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near texts stays: links of op10's fingerprints, then less alike texts; all are held
    against the shingle sets (five words, similarity 0.8)."""
    ship_package(spark)
    return without_near_duplicates(docs.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; a document of which nothing is left goes."""
    ship_package(spark)
    docs = docs.select(COLUMNS)
    cut = cut_passages(docs, repeated_passages(docs))
    return cut.filter(F.col("text").isNull() | (F.col("text") != "")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    ship_package(spark)
    return without_contaminated(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the fitted model nor the chunks; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of a stage's tables only its result stays, until the next one has read it."""
    docs, mark = read_table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard_since(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
