"""python -m lodestone.cli "<question>" <folder>

Environment: OLLAMA_BASE_URL, EMBED_MODEL, RETRIEVAL (dense or hybrid), RERANK (1 turns it
on), RERANK_BASE_URL, RERANK_API_KEY, RERANK_MODEL.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import Row

from lodestone.operators.embedders import OllamaEmbedder
from lodestone.operators.rerank import RerankOptions
from lodestone.plans.pipeline import DENSE, HYBRID, ask, ingest
from lodestone.session import local_session


def shown(rank: int, row: Row) -> str:
    source = json.loads(row.metadata or "{}").get("source", row.id)
    return f"{rank}. [{row.score:.3f}] {source}\n   {' '.join(row.text[:200].split())}...\n"


def main(args: list[str]) -> int:
    if len(args) != 2 or not all(args):
        print(__doc__, file=sys.stderr)
        return 1
    question, folder = args
    env = os.environ.get
    embedder = OllamaEmbedder(env("OLLAMA_BASE_URL", OllamaEmbedder.base_url), env("EMBED_MODEL", OllamaEmbedder.model))
    spark = local_session()
    store = ingest(spark, folder, embedder)
    print(f"{store.size} chunks", file=sys.stderr)
    options = None
    if env("RERANK") == "1":
        options = RerankOptions(env("RERANK_BASE_URL", "http://localhost:11434/v1"), env("RERANK_API_KEY"), env("RERANK_MODEL", RerankOptions.model))
    questions = spark.createDataFrame([(0, question)], "query_id long, text string")
    retrieval = HYBRID if env("RETRIEVAL") == HYBRID else DENSE
    found = ask(questions, store, embedder, retrieval=retrieval, rerank_results=options is not None, rerank_options=options)
    print(f"Q: {question}\n")
    for row in found.orderBy("rank").collect():
        print(shown(row.rank, row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
