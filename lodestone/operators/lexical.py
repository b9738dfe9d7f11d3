"""BM25 over an inverted index of DataFrames.

The index is three tables: postings (term, doc_ord, tf, len, df), document lengths, and
one row of corpus statistics. Lengths and document frequencies stand in the postings, so
a search is one equi-join on term and one aggregation. Queries come in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.session import kept


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame

    @property
    def size(self) -> int:
        return self.lengths.count()

    def save(self, path: str) -> None:
        """Postings sorted by term, so that a search prunes row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    def kept(self) -> Bm25Index:
        """The index written once to the shared folder, for several searches."""
        return Bm25Index(kept(self.postings, "postings"), kept(self.lengths, "lengths"), kept(self.stats, "stats"))

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats")))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(doc_ord, term, tf)."""
    terms = docs.select("doc_ord", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("doc_ord", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_ord, len): tokens that count; documents without any have 0."""
    return docs.select("doc_ord", F.size(tokenize(F.col("text"))).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n, avg_len); an average of 0 becomes 1."""
    mean = F.sum("len") / F.count("*")
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.when(mean != 0, mean), F.lit(1.0)).alias("avg_len"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def build_index(docs: DataFrame) -> Bm25Index:
    """Of docs (doc_ord, text), where doc_ord is unique and gives the order of ties."""
    tokens = docs.select("doc_ord", tokenize(F.col("text")).alias("tokens"))
    # The length goes along, so that no join has to bring it. An outer explode, since for an inner
    # one the optimizer would tokenise once more to filter empty rows at the scan.
    terms = tokens.select("doc_ord", F.size("tokens").cast("long").alias("len"), F.explode_outer("tokens").alias("term")).where("term is not null")
    # Written, so that frequencies are counted from terms alone and not from the texts again.
    tf = kept(terms.groupBy("doc_ord", "len", "term").agg(F.count("*").alias("tf")), "terms")
    postings = tf.join(document_frequency(tf), "term")
    lengths = document_lengths(docs)
    return Bm25Index(postings.select("term", "doc_ord", "tf", "len", "df"), lengths, corpus_stats(lengths))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, term_pos): each term of a query once, at its first place."""
    places = queries.select("query_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))
    return places.groupBy("query_id", "term").agg(F.min("pos").alias("term_pos"))


def scores(index: Bm25Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_ord, score, first_term) for documents that share a term."""
    tf = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len"))
    hits = query_terms(queries).join(index.postings, "term").crossJoin(F.broadcast(index.stats))
    part = idf(F.col("n"), F.col("df")) * tf * F.lit(k1 + 1.0) / (tf + norm)
    return hits.groupBy("query_id", "doc_ord").agg(F.sum(part).alias("score"), F.min("term_pos").alias("first_term"))


def search(index: Bm25Index, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_ord, score): the k best; ties by the first matching query term,
    then document order. k <= 0 gives no rows."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_term", "doc_ord")
    ranked = scores(index, queries, k1, b).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max(k, 0)).select("query_id", "rank", "doc_ord", "score")
