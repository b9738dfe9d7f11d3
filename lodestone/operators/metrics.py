"""Retrieval metrics of rankings (query_id, rank, id) against judgments (query_id, id, grade)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(qrels: DataFrame, order: str) -> DataFrame:
    """One grade for each (query_id, id): that of the last row."""
    return qrels.groupBy("query_id", "id").agg(F.max_by("grade", order).alias("grade"))


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def per_query(rankings: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (10, 100)) -> DataFrame:
    """(query_id, ndcg, mrr, recall_<cut>...): one row for each judged query; one without a
    ranking has zeros. ndcg and mrr are taken at the first cut. A repeated id counts again
    for recall, as often as it is ranked."""
    k = cuts[0]
    if min(cuts) < 0:
        raise ValueError("cuts must not be negative")
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id")
    ideal = (
        qrels.where("grade > 0")
        .withColumn("rank", F.row_number().over(best))
        .groupBy("query_id")
        .agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))).alias("ideal"))
    )
    good = F.coalesce("grade", F.lit(0)) > 0
    found = (
        rankings.join(qrels, ["query_id", "id"])
        .groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"),
            F.min(F.when(good & (F.col("rank") <= k), F.col("rank"))).alias("first"),
            *[F.count_if(good & (F.col("rank") <= c)).alias(f"hits_{c}") for c in cuts],
        )
    )
    judged = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(found, "query_id", "left")
    zero = F.lit(0.0)
    return judged.select(
        "query_id",
        F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), zero).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        *[F.coalesce(F.col(f"hits_{c}") / F.col("relevant"), zero).alias(f"recall_{c}") for c in cuts],
    )


def scorecard(method: str, rankings: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (10, 100)) -> DataFrame:
    """One row: the method and the means over all judged queries."""
    each = per_query(rankings, qrels, cuts)
    return each.agg(*[_mean(F.col(c)).alias(c) for c in each.columns[1:]]).select(F.lit(method).alias("method"), "*")


def grid(methods: dict[str, DataFrame], qrels: DataFrame, cuts: tuple[int, ...] = (10, 100)) -> DataFrame:
    return reduce(DataFrame.unionByName, [scorecard(m, r, qrels, cuts) for m, r in methods.items()])


def mean(values: DataFrame, column: str) -> DataFrame:
    """0 for no rows."""
    return values.agg(_mean(F.col(column)).alias("mean"))


def markdown(cards: DataFrame) -> str:
    """The summary as a table, three decimals."""
    rows = cards.collect()
    names = cards.columns
    lines = ["| " + " | ".join(names) + " |", "|---|" + "---:|" * (len(names) - 1)]
    return "\n".join(lines + ["| " + " | ".join([r[0], *[f"{x:.3f}" for x in r[1:]]]) + " |" for r in rows])


def record(cards: DataFrame, **facts) -> str:
    """The summary as one JSON document: the given facts, then the methods with all figures."""
    return json.dumps(facts | {"methods": [r.asDict() for r in cards.collect()]}, ensure_ascii=False, indent=2)
