"""Sinks: tab-separated tables, nested JSON per sample, the joint table, and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text joined by semicolons, booleans as lower-case words, for text files."""
    kinds = dict(df.dtypes)
    shown = {c: F.when(F.col(c).isNotNull(), F.array_join(c, ";")) for c, k in kinds.items() if k.startswith("array<")}
    return df.withColumns(shown) if shown else df


def write_tsv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Tab-separated with a header, NULL as NA; an empty table still has its header."""
    out = _flat(df)
    writer = (out.coalesce(1) if out.isEmpty() else out).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def sample_json(samples: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row a sample, with each named table's rows of that sample as a list (empty where it has none)."""
    out = samples
    for name, table in parts.items():
        columns = [c for c in table.columns if c != "sample_id"]
        rows = table.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, "sample_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def joint_wide(joint: DataFrame, samples: list[str]) -> DataFrame:
    """The joint table with a column for each of the stated samples: allele, N for ambiguous, ? for not callable."""
    return joint.groupBy("chrom", "pos", "ref").pivot("sample_id", samples).agg(F.first("allele"))


def write_mask(mask: DataFrame, path: str) -> None:
    """A BED file of a merged mask, in order."""
    mask.select("chrom", "start_pos", "end_pos").orderBy("chrom", "start_pos").write.mode("overwrite").option("sep", "\t").csv(path)


def write_views(views: dict[str, DataFrame], root: str) -> None:
    """One Parquet data set for each named view, parted by sample where it has one."""
    for name, df in views.items():
        writer = df.write.mode("overwrite")
        if "sample_id" in df.columns:
            writer = writer.partitionBy("sample_id")
        writer.parquet(f"{root}/{name}")
