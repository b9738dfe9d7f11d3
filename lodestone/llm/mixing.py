"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue in a shuffled order, once for each round the mix
may repeat it. Its virtual finish time is the number of tokens its source has queued up
to and with it, divided by the source's target; documents of all sources, ordered by
finish time, are taken until the total budget is reached. Cumulative sums are never made
in one task: rows fall in hash ranges of bounded size, whose sums are added up first.

Nulls: a null source is a source of its own and comes last; a null text has size 0; a
null doc_id is a document like others. Rows of equal doc_id and text have equal places in
the queue but each counts. Documents of size 0 take 0. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORDS, estimated_bytes, saved


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size): the share of all tokens,
    dealt by weight, none above `repeats` times its source.

    A source stops at its bound if its bound by weight is no more than the level the rest
    would reach; of the levels that stay below their ratio the first, which is the greatest, holds.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    cycle = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (((F.row_number().over(by_source) - 1) % len(weights)) + 1).cast("int"),
    )
    bound = F.col("source_size") * F.lit(float(repeats))
    ranked = (
        sizes.withColumn("weight", cycle)
        .withColumn("ratio", bound / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.sum(bound).over(upto) - bound)
        .withColumn("open", F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("reached", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    )
    target = F.least(bound, F.coalesce(F.col("weight") * F.col("reached"), bound))
    return ranked.select("source", "source_size", target.alias("target"), "budget")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` up to each row, by keys, in the order (bucket, *order).

    Sums of buckets are added up over the small table of buckets, then within buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    same = [df[c].eqNullSafe(sums[c]) for c in [*keys, bucket]]
    joined = df.join(sums, same, "left").select(df["*"], sums["_before"])
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum(value).over(within) + F.col("_before")).drop("_before")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "",
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken); sources by code point take the
    weights in turn. `taken` is 0 or a multiple of size up to `repeats` times."""
    buckets = max(16, math.ceil(estimated_bytes(docs) / 500 / rows_per_bucket))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    sized = saved(
        docs.select(
            "doc_id",
            "source",
            token_count(F.col("text")).alias("size"),
            order.alias("_order"),
            F.floor(place * buckets / F.lit(2.0**32)).cast("int").alias("_bucket"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mixing-sizes",
    )
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    ties = ["_order", "doc_id", "size", "_row"]
    queued = running_sum(sized, ["source"], "_bucket", [F.col(c) for c in ties], "size", "_queued")
    goals = goals.withColumnRenamed("source", "_source")
    queued = saved(queued.join(goals, queued["source"].eqNullSafe(goals["_source"])).drop("_source"), "mixing-queue")

    rounds = queued.where("size > 0").select("*", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("_round"))
    finish = (F.col("_queued") + F.col("_round") * F.col("source_size")) / F.col("target")
    rank = [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_round"), *[F.col(c) for c in ties]]
    ranged = saved(
        rounds.select("*", finish.alias("_finish"))
        .repartitionByRange(buckets, *rank)
        .select("_row", "doc_id", "source", "size", "budget", "_order", "_round", "_finish", F.spark_partition_id().alias("_slot")),
        "mixing-order",
    )
    ranked = running_sum(ranged, [], "_slot", rank, "size", "_total")
    taken = ranked.where("_total <= budget").groupBy("_row").agg(F.sum("size").alias("_taken"))
    return queued.join(taken, "_row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
    )
