"""What the operators of this subpackage share: reading tables and cutting lineage in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of one white-space byte as the contracts name them.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, narrowed to the columns given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and the session runs in one process (local mode, as in tests) a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quaver-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that a lost executor never repeats what led to them.

    The query's shuffle files go as soon as its rows are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on the session hands Python workers at most so many bytes at a time: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def word_count(text):
    """Number of maximal runs of bytes other than 0x20 and 0x09-0x0D; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    size = F.size(parts)
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + ((size > 1) & (F.get(parts, size - 1) == "")).cast("int")
    return (size - ends).cast("long")
