"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir

BATCH_BYTES = 16 << 20
#: Most partitions of a shuffle.
PARTS = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Size of the files or tables below df; only partition counts depend on it. Where a
    source doesn't know its size, each of its partitions stands for 16 MB."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) >= 1 << 60:
        return df.rdd.getNumPartitions() * 16_000_000
    return sum(sizes)


def parts_for(df: DataFrame, mb: float, least: int = 8) -> int:
    """So many shards that each stands for about this much input."""
    return max(least, math.ceil(estimated_bytes(df) / (mb * 1e6)))


def dealt(blocks: DataFrame, shards: int) -> DataFrame:
    """Rows by their column `shard`; a partition has several shards, one after another, where
    there are more than PARTS."""
    parts = min(shards, PARTS)
    out = blocks.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int"))
    return out.sortWithinPartitions("shard") if shards > parts else out


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python workers in batches of at most BATCH_BYTES, of which a task holds
    several copies; a lower limit of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, by which rows are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def saved(df: DataFrame, kind: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends, executors may go."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of saved rows that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
