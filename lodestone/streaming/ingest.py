"""Chunking and embedding files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import chunking, embedders


def stream_chunks(spark: SparkSession, folder: str, embedder: embedders.Embedder, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends chunks with vectors of new texts in the folder to Parquet at `out`."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text")).where(F.col("doc_id").rlike(r"^.+\.(md|mdx|txt)$"))

    def append(batch: DataFrame, _: int) -> None:
        embedders.attach(chunking.chunk_corpus(batch, **options), embedder).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
