"""Connected components of links that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, saved

#: A hub's neighbours meet its least one in so many places.
SALT = 8


def union(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root after joining x with y; roots are the least of what they join."""
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        differ = root[x] != root[y]
        x, y = x[differ], y[differ]
    return root


def settled(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root = root[root]
    return root


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects what the edges (a, b) connect: node, least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = settled(union(np.arange(len(nodes)), at[: len(a)], at[len(a) :]))
    some = np.flatnonzero(root != np.arange(len(root)))
    return nodes[some], nodes[root[some]]


class Forest:
    """A spanning forest of edges that come in parts."""

    def __init__(self):
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.more.append((a, b))
        self.waiting += len(a)
        if self.waiting > max(200_000, 2 * len(self.a)):
            self.merge()

    def merge(self) -> None:
        self.a, self.b = spanning(np.concatenate([self.a, *[m[0] for m in self.more]]), np.concatenate([self.b, *[m[1] for m in self.more]]))
        self.more, self.waiting = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for i in range(0, len(self.a), 100_000):
            x = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.a[x]), pa.array(self.b[x])], ["a", "b"])


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) to a spanning forest of them."""
    found = Forest()
    for batch in batches:
        found.add(batch.column("a").to_numpy(), batch.column("b").to_numpy())
    yield from found.batches()


def components(edges: DataFrame, kind: str = "links", thin: bool = False) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a, b).

    Every task first thins its edges to a forest, unless they are `thin` already. Then large-star and small-star in turn: each
    round joins nodes to the least neighbour, and ends when every node hangs on its
    component's least. A hub's neighbours are dealt by SALT places, in a shuffle that no
    aggregation shares, so that a still larger one can be split at run time. Rounds are
    written to the shared folder, so lineage stays short. Nulls and self-links are left out;
    no edges, no rows.
    """
    edges = edges.where("a <> b").select("a", "b")
    edges = edges if thin else edges.mapInArrow(forest, "a long, b long")
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), kind)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("high > a")
        least = least.select("a", F.least("low", "a").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        dealt = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
        large = dealt.join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, saved(joined.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), kind)
        dropped(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out._saved_at = e._saved_at
    return out
