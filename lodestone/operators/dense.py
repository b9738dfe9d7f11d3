"""Cosine similarity and exact dense top-k.

`top_k` matches query blocks with whole Arrow batches of vectors by matrix products and
lets only each batch's best leave the task; queries are broadcast in slices of bounded
size, of which the driver holds one at a time. `top_k_any` takes vectors of any lengths: those as long as the queries go that
way, the rest by `top_k_pairs`, every pair by array functions (where lengths differ the
common prefix counts, for norms too). `top_k_sql` is a plan of built-in expressions: vectors
of the queries' commonest length as columns, the rest by `top_k_pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one broadcast may hold.
SLICE = 32 << 20
#: Products that one sum adds up.
PIECE = 64
RESULT = "query_id long, ord long, score double"


def cosine(a: Column, b: Column) -> Column:
    """Over the common prefix, in double precision; 0 where a norm is 0 or a vector empty."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    add = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(add(x, x)) * F.sqrt(add(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(add(x, y) / norm)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))
    return out.select("query_id", "rank", "ord", "score")


def top_k_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, ord, score) of vectors (ord, embedding), queries (query_id, embedding),
    of any lengths: every pair is scored by itself and sorted."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    return ranked(vectors.crossJoin(q).select("query_id", "ord", cosine(F.col("q"), F.col("embedding")).alias("score")), k)


def _whole(dim: int) -> Column:
    """Whether an embedding has dim components, none of them null."""
    e = F.col("embedding")
    return F.coalesce((F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull()), F.lit(False))


def _columns(df: DataFrame, key: str, prefix: str, dim: int) -> DataFrame:
    """A whole embedding's norm and components, a column each."""
    x = df.select(key, F.col("embedding").cast("array<double>").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    parts = {"norm": norm} | {i: F.get("x", F.lit(i)) for i in range(dim)}
    return x.select(key, *(F.coalesce(c, F.lit(0.0)).alias(f"{prefix}{name}") for name, c in parts.items()))


def _top_k_columns(vectors: DataFrame, queries: DataFrame, k: int, dim: int, slices: int, one_in: int) -> DataFrame:
    """top_k_pairs of whole vectors, where a score is one compiled expression of columns and
    pairs are not sorted.

    The k-th best score among the vectors of one hash in `one_in` is one that at least k of all
    vectors reach. All pairs are scored and held against it; those below, by more than rounding
    to nine places can lift, are out, and the rest (about k * one_in for a query, and ties) is
    ranked.
    """
    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    v = _columns(vectors, "ord", "v", dim).repartition(tasks, "ord")
    some = _columns(vectors.where(F.pmod(F.xxhash64("ord"), F.lit(one_in)) == 0), "ord", "v", dim).repartition(tasks, "ord")
    q = _columns(queries, "query_id", "q", dim)
    add = lambda parts: reduce(Column.__add__, parts, F.lit(0.0))
    products = [F.col(f"q{i}") * F.col(f"v{i}") for i in range(dim)]
    # in pieces, since an expression as deep as long vectors would be too deep for the planner
    dot = add(products) if dim <= PIECE else add(add(products[i : i + PIECE]) for i in range(0, dim, PIECE))
    scale = F.col("qnorm") * F.col("vnorm")
    score = F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale)
    found = []
    for i in range(slices):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else q
        first = ranked(some.crossJoin(F.broadcast(part)).select("query_id", "ord", score.alias("score")), k)
        least = first.where(F.col("rank") == k).select("query_id", (F.col("score") - 2e-9).alias("least"))
        bound = part.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found.append(v.crossJoin(F.broadcast(bound)).where(score >= F.col("least")).select("query_id", "ord", score.alias("score")))
    return ranked(reduce(DataFrame.unionByName, found), k)


def top_k_sql(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As top_k_pairs. Vectors and queries of the queries' commonest length go by columns."""
    sizes = queries.where(_whole(F.size("embedding")) & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("dim")).count()
    most = sizes.orderBy(F.desc("count"), "dim").first() if k > 0 else None
    if not most:
        return top_k_pairs(vectors, queries, k)
    whole = _whole(most.dim)
    mine = queries.where(whole)
    n = vectors.agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("odd")).first()
    # both rankings, for the bound and of what reaches it, are of about sqrt(n * k) vectors
    found = [_top_k_columns(vectors.where(whole), mine, k, most.dim, max(1, -(-most["count"] * 8 * most.dim // SLICE)), max(1, isqrt(n.whole // k)))]
    if n.odd:
        found.append(top_k_pairs(vectors.where(~whole), mine, k))
    if not queries.where(~whole).isEmpty():
        found.append(top_k_pairs(vectors, queries.where(~whole), k))
    return ranked(reduce(DataFrame.unionByName, found).drop("rank"), k) if len(found) > 1 else found[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        norms = np.sqrt((matrix * matrix).sum(1))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column("embedding"))
                ords = part.column("ord").to_numpy()
                below = np.sqrt((x * x).sum(1))[None, :]
                keep = min(k, len(ords))
                for s in range(0, len(ids), 256):
                    scale = norms[s : s + 256, None] * below
                    dots = matrix[s : s + 256] @ x.T
                    score = np.where(scale == 0, 0.0, dots / np.where(scale == 0, 1.0, scale))
                    rounded = np.round(score, 9)
                    if keep < len(ords):
                        # all that tie with the k-th stay, so the final order decides
                        least = -np.partition(-rounded, keep - 1, axis=1)[:, keep - 1 : keep]
                        q, v = np.nonzero(rounded >= least)
                    else:
                        q, v = np.divmod(np.arange(rounded.size), len(ords))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s + q]), pa.array(ords[v]), pa.array(score[q, v])], ["query_id", "ord", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """As top_k_sql, for vectors of dim components each."""
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, ord long, score double")
    per = max(1, SLICE // (8 * dim))
    n = queries.count()
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    v = vectors.select(F.col("ord").cast("long").alias("ord"), "embedding")
    found = []
    slices = max(1, -(-n // per))
    for i in range(slices):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else q
        rows = part.toArrow()
        ids = rows.column("query_id").to_numpy()
        matrix = _matrix(rows.column("embedding").combine_chunks()) if len(ids) else np.zeros((0, dim))
        found.append(v.mapInArrow(_best(q.sparkSession.sparkContext.broadcast((ids, matrix)), k), RESULT))
    return ranked(reduce(DataFrame.unionByName, found), k)


def top_k_any(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As top_k_sql, by matrix products wherever lengths agree."""
    spark = vectors.sparkSession
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = lambda e: F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda x: x.isNotNull())
    dims = [r.n for r in q.where(plain("embedding")).select(F.size("embedding").alias("n")).distinct().collect()]
    odd = q.where(~F.coalesce(plain("embedding"), F.lit(False)))
    found = [spark.createDataFrame([], "query_id long, rank int, ord long, score double")]
    for dim in dims if k > 0 else ():
        mine = plain("embedding") & (F.size("embedding") == dim)
        found.append(top_k(vectors.where(mine), q.where(mine), k, dim))
        rest = vectors.where(~F.coalesce(mine, F.lit(False)))
        found.append(top_k_pairs(rest, q.where(mine), k))
    if k > 0:
        found.append(top_k_pairs(vectors, odd, k))
    return ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)
