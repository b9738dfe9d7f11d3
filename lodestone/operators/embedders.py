"""Embedding back ends, and attaching their vectors to rows.

An embedder is built without any traffic and shipped to the tasks; each task sends its
texts in batches over one client. Failures propagate: a vector is never made up.
Retried tasks may send a text again.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def post(url: str, body: dict, timeout: float, key: str | None = None) -> dict:
    """JSON answer of a JSON request; HTTP errors name the status and the answer's start."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"request failed ({e.code}): {e.read().decode(errors='replace')[:200]}") from None


def one(embedder: Embedder, text: str) -> list[float]:
    vectors = embedder.embed_batch([text])
    if not vectors:
        raise RuntimeError("the answer holds no vectors")
    return vectors[0]


@dataclass(frozen=True)
class OllamaEmbedder:
    base_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    timeout: float = 30.0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        answer = post(f"{self.base_url.rstrip('/')}/api/embed", {"model": self.model, "input": texts}, self.timeout)
        if not isinstance(answer.get("embeddings"), list):
            raise RuntimeError('the answer lacks "embeddings"')
        return answer["embeddings"]


@dataclass(frozen=True)
class OpenAICompatEmbedder:
    base_url: str
    api_key: str = field(repr=False)
    model: str = "text-embedding-3-small"
    timeout: float = 30.0

    def __post_init__(self) -> None:
        if not self.api_key:
            raise ValueError("an API key is required")

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        answer = post(f"{self.base_url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, self.timeout, self.api_key)
        if not isinstance(answer.get("data"), list):
            raise RuntimeError('the answer lacks "data"')
        return [d["embedding"] for d in answer["data"]]


@dataclass(frozen=True)
class LetterEmbedder:
    """Counts of some characters and a constant: a stand-in that needs no model."""

    letters: str = "aeiou "

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[*(float(t.count(c)) for c in self.letters), 1.0] for t in texts]


def hashed(text: Column, dim: int = 64) -> Column:
    """Token counts by md5 bucket: a deterministic stand-in that needs no model."""
    bucket = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim

    @F.pandas_udf("array<double>")
    def counts(buckets: pd.Series) -> pd.Series:
        sizes = buckets.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *buckets])
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dim + flat, minlength=len(sizes) * dim)
        return pd.Series(list(counts.reshape(len(sizes), dim).astype(float)))

    return counts(F.transform(tokenize(text), bucket))


def attach(rows: DataFrame, embedder: Embedder, text: str = "text", prefix: str = "", batch: int = 64) -> DataFrame:
    """All columns and `embedding`, the vector of prefix + text; as many vectors as texts
    must come back."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, part.num_rows, batch):
                some = part.slice(a, batch)
                texts = [prefix + (t or "") for t in some.column(text).to_pylist()]
                vectors = embedder.embed_batch(texts)
                if len(vectors) != len(texts):
                    raise RuntimeError(f"{len(texts)} texts got {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(vectors, pa.list_(pa.float64()))], [*names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, embedding array<double>")


def attach_cached(rows: DataFrame, embedder: Embedder, path: str, key: str = "chunk_id", **options) -> DataFrame:
    """attach(), kept as Parquet at `path`: read again if it covers the same keys."""
    spark = rows.sparkSession
    try:
        cached = spark.read.parquet(path)
        if cached.count() == rows.count() and not rows.join(cached, key, "left_anti").take(1):
            return rows.join(cached, key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    made = attach(rows, embedder, **options)
    made.select(key, "embedding").write.mode("overwrite").parquet(path)
    return rows.join(spark.read.parquet(path), key)


