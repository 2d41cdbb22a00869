"""Session helpers: reading the given tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()
#: Folders of intermediate tables, in the order in which they were written.
_written: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: they need not have it installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).parent
    handle, name = tempfile.mkstemp(prefix="isolates-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path may be any that Spark's readers open."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-isolates-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many intermediate tables there have been: a mark for :func:`discard_since`."""
    return len(_written)


def discard_since(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Delete the intermediate tables written since ``mark``, but for the last ``keep`` of them.

    For the end of a step whose result has been written: nothing lazy may still read the others.
    """
    last = len(_written) - keep
    for path in _written[mark:last]:
        _delete(spark, path)
    del _written[mark:last]


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if not path.toUri().getPath().startswith(root):
            raise ValueError(f"{folder} is not an intermediate table")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
