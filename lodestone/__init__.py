"""Spark-first retrieval analytics: chunking, BM25, dense and hybrid search, metrics."""
