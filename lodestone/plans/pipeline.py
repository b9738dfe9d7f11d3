"""Ingesting folders and answering questions: chunk, embed, search, fuse, re-rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, embedders, fusion
from lodestone.operators.order import numbered
from lodestone.operators.rerank import RerankOptions, rerank
from lodestone.sources.files import read_texts
from lodestone.sources.store import ChunkStore

DENSE, HYBRID = "dense", "hybrid"


def ingest(spark: SparkSession, folder: str, embedder: embedders.Embedder, max_chars: int = 1200, overlap_chars: int = 150) -> ChunkStore:
    """Chunks of a folder's texts with their vectors, ordered by file name and place."""
    made = chunking.chunk_corpus(read_texts(spark, folder), max_chars, overlap_chars)
    vectors = numbered(embedders.attach(made, embedder), [F.col("source"), F.col("index")], "chunk_ord")
    metadata = F.to_json(F.struct("source", F.col("char_start").alias("charStart"), F.col("char_end").alias("charEnd")))
    return ChunkStore(vectors.select(F.col("chunk_id").alias("id"), "chunk_ord", "text", "embedding", metadata.alias("metadata")))


def pool_size(k: int, pool: int | None) -> int:
    return max(4 * k, 20) if pool is None else pool


def retrieve(store: ChunkStore, queries: DataFrame, pool: int, retrieval: str = DENSE) -> DataFrame:
    """(query_id, rank, id, score) for queries (query_id, text, embedding)."""
    dense = store.search(queries.select("query_id", "embedding"), pool)
    if retrieval != HYBRID:
        return dense
    fused = fusion.rrf([dense, store.keyword_search(queries.select("query_id", "text"), pool)])
    return fused.where(F.col("rank") <= pool)


def ask(
    questions: DataFrame,
    store: ChunkStore,
    embedder: embedders.Embedder,
    k: int = 5,
    retrieval: str = DENSE,
    pool: int | None = None,
    rerank_results: bool = False,
    rerank_options: RerankOptions | None = None,
) -> DataFrame:
    """(query_id, rank, id, score, text, metadata) for questions (query_id, text).

    The score is the cosine, or the fused score of a hybrid search. A pool smaller than k
    truncates. Results are re-ranked only if asked for and options are given.
    """
    queries = embedders.attach(questions.select("query_id", "text"), embedder)
    found = retrieve(store, queries, pool_size(k, pool), retrieval)
    texts = store.by_id()
    if rerank_results and rerank_options:
        found = rerank(found.join(texts.select("id", "text"), "id"), questions, k, rerank_options)
    else:
        found = found.where(F.col("rank") <= k)
    return found.join(texts, "id").select("query_id", "rank", "id", "score", "text", "metadata")
