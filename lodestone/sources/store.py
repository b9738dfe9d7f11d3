"""A store of embedded chunks, kept as Parquet or as one JSON document."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, lexical

SCHEMA = "id string, chunk_ord long, text string, embedding array<double>, metadata string"
DOCUMENT = "version int, builtAt string, chunks array<struct<id:string,text:string,embedding:array<double>,metadata:variant>>"
EPOCH = "1970-01-01T00:00:00.000Z"


class ChunkStore:
    """Chunks (id, chunk_ord, text, embedding, metadata as JSON text); chunk_ord gives the
    order of ties. The lexical index is built on first use."""

    def __init__(self, chunks: DataFrame, built_at: str | None = None):
        self.chunks = chunks
        self.built_at = built_at or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        self._index: lexical.Bm25Index | None = None

    @classmethod
    def from_chunks(cls, spark: SparkSession, rows: Iterable[dict]) -> ChunkStore:
        listed = [
            (r["id"], i, r["text"], [float(x) for x in r["embedding"]], json.dumps(r["metadata"]) if r.get("metadata") is not None else None)
            for i, r in enumerate(rows)
        ]
        return cls(spark.createDataFrame(listed, SCHEMA))

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> ChunkStore:
        """A missing file or broken JSON raises; missing chunks are none, a missing date the epoch."""
        doc = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path, multiLine=True)
        built = doc.select(F.coalesce("builtAt", F.lit(EPOCH))).first()
        chunks = doc.select(F.posexplode("chunks").alias("chunk_ord", "c")).select(
            "c.id", F.col("chunk_ord").cast("long"), "c.text", "c.embedding", F.to_json("c.metadata").alias("metadata")
        )
        return cls(chunks, built[0] if built else EPOCH)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChunkStore:
        meta = spark.read.schema("built_at string").json(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/chunks"), meta.built_at)

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.chunks.sparkSession.createDataFrame([(self.built_at,)], "built_at string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    def save_json(self, path: str) -> None:
        """One JSON document, for exchange; the driver writes it row by row, to any file system
        that Spark knows."""
        spark = self.chunks.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        held = [f'{{"version":1,"builtAt":{json.dumps(self.built_at)},"chunks":[']

        def flush() -> None:
            out.write(bytearray("".join(held).encode()))
            held.clear()

        try:
            for i, r in enumerate(self.chunks.orderBy("chunk_ord").toLocalIterator()):
                row = {"id": r.id, "text": r.text, "embedding": list(r.embedding)}
                if r.metadata is not None:
                    row["metadata"] = json.loads(r.metadata)
                held.append(("," if i else "") + json.dumps(row, ensure_ascii=False))
                if len(held) >= 1000:
                    flush()
            held.append("]}")
            flush()
        finally:
            out.close()

    @property
    def size(self) -> int:
        return self.chunks.count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score) by cosine with queries (query_id, embedding)."""
        vectors = self.chunks.select(F.col("chunk_ord").alias("ord"), "embedding")
        hits = dense.top_k_any(vectors, queries, k)
        return hits.join(self.chunks.select(F.col("chunk_ord").alias("ord"), "id"), "ord").select("query_id", "rank", "id", "score")

    def keyword_search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score) by BM25 with queries (query_id, text)."""
        if self._index is None:
            self._index = lexical.build_index(self.chunks.select(F.col("chunk_ord").alias("doc_ord"), "text"))
        hits = lexical.search(self._index, queries, k)
        return hits.join(self.chunks.select(F.col("chunk_ord").alias("doc_ord"), "id"), "doc_ord").select("query_id", "rank", "id", "score")

    def by_id(self) -> DataFrame:
        """(id, text, metadata): of rows that share an id, the last."""
        last = self.chunks.groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "chunk_ord").alias("c"))
        return last.select("id", "c.text", "c.metadata")
