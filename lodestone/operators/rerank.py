"""Re-ordering candidates by a chat model's reply. A failure of any kind keeps the order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.embedders import post

SHOWN = 800
LIST = re.compile(r"\[[0-9,\s]+\]")


@dataclass(frozen=True)
class RerankOptions:
    base_url: str
    api_key: str | None = field(default=None, repr=False)
    model: str = "gpt-4o-mini"
    timeout: float = 8.0


def prompt(query: str, texts: list[str]) -> str:
    shown = "\n\n".join(f"[{i}] {t[:SHOWN]}" for i, t in enumerate(texts))
    return (
        f"Query: {query}\n\nCandidates:\n{shown}\n\nRank the candidates by relevance to the query, best first. "
        f"Answer with a JSON array of all {len(texts)} bracketed numbers and nothing else."
    )


def order_of(reply: object, n: int, k: int) -> list[int]:
    """The k first places of the reply's list, topped up in the given order; the given order
    if the reply holds no usable list. A usable list gives one place at least."""
    given = list(range(min(n, max(k, 0))))
    if n <= k or not isinstance(reply, str) or not (found := LIST.search(reply)):
        return given
    try:
        listed = json.loads(found[0])
    except ValueError:
        return given
    if not listed:
        return given
    places = list(dict.fromkeys(i for i in listed if i < n))
    chosen = set(places)
    places = places[: max(k, 1)]
    return places + [i for i in range(n) if i not in chosen][: max(k - len(places), 0)]


def ask_model(options: RerankOptions, query: str, texts: list[str]) -> object:
    """The reply's text; None for an answer of another shape or any failure."""
    body = {"model": options.model, "messages": [{"role": "user", "content": prompt(query, texts)}], "temperature": 0}
    try:
        answer = post(f"{options.base_url.rstrip('/')}/chat/completions", body, options.timeout, options.api_key)
        return answer["choices"][0]["message"]["content"]
    except Exception:  # noqa: BLE001  whatever goes wrong, the search result stays
        return None


def rerank_with(candidates: DataFrame, queries: DataFrame, k: int, reply: Callable[[str, list[str]], object]) -> DataFrame:
    """(query_id, rank, id, score) from candidates (query_id, rank, id, text, score).

    One row per query holds its candidates, whose number the pool size bounds; only
    queries with more than k candidates ask for a reply.
    """
    listed = F.sort_array(F.collect_list(F.struct("rank", "id", "text", "score")))
    grouped = candidates.groupBy("query_id").agg(listed.alias("c")).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    kind = candidates.schema["query_id"].dataType.simpleString()
    ids = candidates.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                c = row["c"]
                said = reply(row["query"], [x["text"] or "" for x in c]) if len(c) > k else None
                out += [(row["query_id"], r, c[i]["id"], c[i]["score"]) for r, i in enumerate(order_of(said, len(c), k), 1)]
            if out:
                q, r, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, batch.schema.field("query_id").type), pa.array(r, pa.int32()), pa.array(i, pa.int64() if ids == "bigint" else pa.string()), pa.array(s, pa.float64())],
                    ["query_id", "rank", "id", "score"],
                )

    return grouped.select("query_id", "query", "c").mapInArrow(run, f"query_id {kind}, rank int, id {ids}, score double")


def rerank(candidates: DataFrame, queries: DataFrame, k: int, options: RerankOptions) -> DataFrame:
    return rerank_with(candidates, queries, k, lambda q, texts: ask_model(options, q, texts))
