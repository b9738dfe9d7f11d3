"""Queries over the test tables, one for each operator, and the SQL they must equal.

Chunk and document ordinals are doc_id order; doubles are rounded to six places on output
and rankings are ordered on nine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, dense, embedders, fusion, lexical, metrics, rerank
from lodestone.plans import pipeline
from lodestone.session import kept, shared_dir, spread
from lodestone.sources.files import read_jsonl, read_qrels
from lodestone.sources.store import ChunkStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc_ord"), "text"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ord"), "embedding", "label")


def listed(spark: SparkSession, lists: list[list[str]], query_id: int = 0) -> list[DataFrame]:
    """Ranked lists of literal ids."""
    return [
        spark.createDataFrame([(query_id, r, x) for r, x in enumerate(ids, 1)], "query_id long, rank int, id string") for ids in lists
    ]


# SQL that several queries share. Words and stopwords are as in functions/text.py.
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = """{name} AS (
  SELECT id, pos, t FROM (SELECT {id} AS id, unnest(string_split_regex(lower({text}), '[^\\p{L}\\p{N}]+')) AS t, generate_subscripts(string_split_regex(lower({text}), '[^\\p{L}\\p{N}]+'), 1) AS pos FROM {table})
  WHERE t <> '' AND t NOT IN ({stop})
)""".replace("{stop}", STOP)


def tokens_sql(name: str, table: str, id_: str, text: str = "text") -> str:
    return TOKENS.replace("{name}", name).replace("{table}", table).replace("{id}", id_).replace("{text}", text)


DOC_TOKENS = tokens_sql("tok", "documents", "doc_id")
INDEX = f"""{DOC_TOKENS},
tf AS (SELECT id, t, count(*) AS tf FROM tok GROUP BY id, t),
len AS (SELECT d.doc_id AS id, count(t) AS len FROM documents d LEFT JOIN tok ON tok.id = d.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, coalesce(nullif(sum(len) / count(*), 0), 1) AS avg_len FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
{tokens_sql("qtok", "benchmark", "item_id")},
q AS (SELECT id AS query_id, t, min(pos) AS p FROM qtok GROUP BY id, t)"""


def bm25_sql(k1: float = 1.2, b: float = 0.75, name: str = "bm") -> str:
    return f"""{name} AS (
  SELECT query_id, tf.id AS doc_ord, min(p) AS p,
    sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {k1 + 1.0}::DOUBLE / (tf + {k1}::DOUBLE * ({1.0 - b}::DOUBLE + {b}::DOUBLE * len / avg_len))) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN len ON len.id = tf.id, st GROUP BY query_id, tf.id
), {name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, p, doc_ord) AS rank FROM {name})"""


DENSE = """dv AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM tok GROUP BY ALL),
qv AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM qtok GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS n FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS n FROM qv GROUP BY id),
dp AS (SELECT qv.id AS q, dv.id AS d, sum(qv.c * dv.c)::DOUBLE AS dot FROM qv JOIN dv ON qv.b = dv.b GROUP BY ALL),
ds AS (SELECT b.item_id AS query_id, d.doc_id AS doc_ord, coalesce(dot / (qn.n * dn.n), 0) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dp ON dp.q = b.item_id AND dp.d = d.doc_id LEFT JOIN qn ON qn.id = b.item_id LEFT JOIN dn ON dn.id = d.doc_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord) AS rank FROM ds)"""
FUSED = """fu AS (
  SELECT query_id, doc_ord, sum(1 / (60.0::DOUBLE + rank)) AS score, min(l * 1000000 + rank) AS seen
  FROM (SELECT query_id, doc_ord, rank, 0 AS l FROM dr WHERE rank <= {pool} UNION ALL SELECT query_id, doc_ord, rank, 1 FROM bmr WHERE rank <= {pool}) GROUP BY query_id, doc_ord
), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM fu)"""


@query(
    f"WITH {DOC_TOKENS} SELECT d.doc_id, count(t)::BIGINT AS n_tokens, count(DISTINCT t)::BIGINT AS n_distinct FROM documents d LEFT JOIN tok ON tok.id = d.doc_id GROUP BY d.doc_id"
)
def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokenize(F.col("text"))
    return docs(spark, d).select(
        F.col("doc_ord").alias("doc_id"), F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct")
    )


@query(f"WITH {DOC_TOKENS} SELECT id AS doc_ord, t AS term, count(*)::BIGINT AS tf FROM tok GROUP BY ALL")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequency(docs(spark, d))


@query(f"WITH {DOC_TOKENS} SELECT t AS term, count(DISTINCT id)::BIGINT AS df FROM tok GROUP BY t")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.term_frequency(docs(spark, d)))


@query(f"WITH {INDEX} SELECT t AS term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.build_index(docs(spark, d))
    once = index.postings.select("term", "df").distinct()
    return once.crossJoin(F.broadcast(index.stats)).select("term", r6(lexical.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"WITH {INDEX} SELECT n::BIGINT AS n, round(avg_len, 6) AS avg_len FROM st")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(lexical.document_lengths(docs(spark, d))).select("n", r6("avg_len").alias("avg_len"))


@query(f"WITH {INDEX} SELECT query_id, t AS term, (row_number() OVER (PARTITION BY query_id ORDER BY p))::INT AS term_no FROM q")
def query_term_dedup(spark: SparkSession, d: str) -> DataFrame:
    terms = lexical.query_terms(items(spark, d))
    return terms.select("query_id", "term", F.row_number().over(Window.partitionBy("query_id").orderBy("term_pos")).alias("term_no"))


@query(f"WITH {INDEX}, {bm25_sql()} SELECT query_id, doc_ord, round(score, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return lexical.scores(lexical.build_index(docs(spark, d)), items(spark, d)).select("query_id", "doc_ord", r6("score").alias("score"))


@query(f"WITH {INDEX}, {bm25_sql()} SELECT query_id, rank::INT AS rank, doc_ord, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(lexical.build_index(docs(spark, d)), items(spark, d), 10).withColumn("score", r6("score"))


VARIANTS = ((1.2, 0.0), (1.2, 1.0), (2.0, 0.5), (0.0, 0.75))


@query(
    "WITH " + INDEX + ", " + ", ".join(bm25_sql(k1, b, f"v{i}") for i, (k1, b) in enumerate(VARIANTS)) + " "
    + " UNION ALL ".join(f"SELECT {i}::INT AS variant, query_id, rank::INT AS rank, doc_ord, round(score, 6) AS score FROM v{i}r WHERE rank <= 5" for i in range(len(VARIANTS)))
)
def bm25_k1b_variants(spark: SparkSession, d: str) -> DataFrame:
    index, q = lexical.build_index(docs(spark, d)).kept(), items(spark, d)
    out = None
    for i, (k1, b) in enumerate(VARIANTS):
        part = lexical.search(index, q, 5, k1, b).select(F.lit(i).alias("variant"), "query_id", "rank", "doc_ord", r6("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


NORMS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, label FROM embeddings)"
COS = "list_inner_product(a.v, b.v) / (a.n * b.n)"


@query(f"WITH {NORMS} SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    a, b = v.select(F.col("ord").alias("a"), F.col("embedding").alias("x")), v.select(F.col("ord").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", r6(dense.cosine(F.col("x"), F.col("y"))).alias("score"))


DENSE_TOPK = f"""WITH {NORMS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS ord, {COS} AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, ord, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM s) WHERE rank <= 10"""


def probes(v: DataFrame) -> DataFrame:
    """The query set: every 50th vector, against all."""
    return v.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "embedding")


@query(DENSE_TOPK)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return dense.top_k(v, probes(v), 10, DIM).withColumn("score", r6("score"))


@query(DENSE_TOPK)
def dense_topk_sql(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return dense.top_k_sql(v, probes(v), 10).withColumn("score", r6("score"))


@query("SELECT 0::BIGINT AS query_id, rank::INT AS rank, ord, 0.0::DOUBLE AS score FROM (SELECT vec_id AS ord, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def dense_topk_zero_vector(spark: SparkSession, d: str) -> DataFrame:
    zero = spark.createDataFrame([(0, [0.0] * DIM)], "query_id long, embedding array<double>")
    return dense.top_k(vectors(spark, d), zero, 5, DIM)


def literal_rrf(rows: list[tuple[str, float]]) -> str:
    return " UNION ALL ".join(f"SELECT 0::BIGINT AS query_id, {i}::INT AS rank, '{x}' AS id, round({s}::DOUBLE, 6) AS score" for i, (x, s) in enumerate(rows, 1))


@query(literal_rrf([("b", 1 / 61 + 1 / 62), ("a", 1 / 61 + 1 / 63), ("d", 1 / 62), ("c", 1 / 63)]))
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(listed(spark, [["a", "b", "c"], ["b", "d", "a"]])).withColumn("score", r6("score"))


@query(literal_rrf([("b", 3 / 61), ("a", 1 / 61)]))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(listed(spark, [["a"], ["b"]]), weights=[1, 3]).withColumn("score", r6("score"))


@query(literal_rrf([("x", 1 / 61), ("y", 1 / 63)]))
def rrf_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(listed(spark, [["x", "x", "y"]])).withColumn("score", r6("score"))


def pools(spark: SparkSession, d: str, pool: int) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical rankings (query_id, rank, id, score) of documents for the items."""
    corpus, q = docs(spark, d), items(spark, d)
    v = corpus.select(F.col("doc_ord").alias("ord"), embedders.hashed(F.col("text"), DIM).alias("embedding"))
    near = dense.top_k(v, q.select("query_id", embedders.hashed(F.col("text"), DIM).alias("embedding")), pool, DIM)
    words = lexical.search(lexical.build_index(corpus), q, pool)
    return near.withColumnRenamed("ord", "id"), words.withColumnRenamed("doc_ord", "id")


HYBRID = f"WITH {INDEX}, {bm25_sql()}, {DENSE}, {FUSED.replace('{pool}', '20')}"


@query(f"{HYBRID} SELECT query_id, rank::INT AS rank, doc_ord, round(score, 6) AS score FROM fr WHERE rank <= 5")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(pools(spark, d, 20)).where("rank <= 5")
    return fused.select("query_id", "rank", F.col("id").alias("doc_ord"), r6("score").alias("score"))


# Chunking: paragraphs, hard splits and packing as recursive queries.
def spans_sql(source: str, size: int, overlap: int) -> str:
    return f"""src AS ({source}),
parts AS (SELECT doc_id, unnest(string_split_regex(text, '\\n{{2,}}')) AS part, generate_subscripts(string_split_regex(text, '\\n{{2,}}'), 1) AS i,
  list_concat(regexp_extract_all(text, '\\n{{2,}}'), ['']) AS seps FROM src),
offs AS (SELECT doc_id, i, part, coalesce(sum(length(part) + length(seps[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM parts),
para AS (SELECT doc_id, i, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS t, (base + length(part) - length(regexp_replace(part, '^\\s+', '')))::BIGINT AS s FROM offs),
live AS (SELECT *, s + length(t) AS e FROM para WHERE t <> ''),
hs AS (
  SELECT doc_id, i, t, s, 0::BIGINT AS pos, 0::BIGINT AS lo, 0::BIGINT AS hi, 0 AS k FROM live WHERE length(t) > {size}
  UNION ALL
  SELECT doc_id, i, t, s, greatest(en - {overlap}, pos + 1), pos, en, k + 1 FROM (
    SELECT *, CASE WHEN pos + {size} >= length(t) THEN length(t)
      WHEN sp > 0 AND 2 * (pos + {size} + 1 - sp - pos) > {size} THEN pos + {size} + 1 - sp ELSE pos + {size} END AS en
    FROM (SELECT *, instr(reverse(substr(t, pos + 1, {size} + 1)), ' ') AS sp FROM hs WHERE k = 0 OR hi < length(t))
  )
),
spans AS (
  SELECT doc_id, i, k, regexp_replace(substr(t, lo + 1, hi - lo), '^\\s+|\\s+$', '', 'g') AS t, s + lo AS s, s + hi AS e FROM hs WHERE k > 0
  UNION ALL SELECT doc_id, i, 1, t, s, e FROM live WHERE length(t) <= {size}
),
sp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS o FROM spans WHERE t <> '')"""


def chunks_sql(source: str, size: int, overlap: int) -> str:
    tail = f"CASE WHEN {overlap} > 0 AND prev <> '' THEN regexp_replace(right(prev, {overlap}), '^\\s+', '') ELSE '' END"
    return f"""WITH RECURSIVE {spans_sql(source, size, overlap)},
pk AS (
  SELECT doc_id, o, t AS buf, s AS bs, e AS be, '' AS prev, 0 AS idx, NULL::VARCHAR AS out, NULL::BIGINT AS os, NULL::BIGINT AS oe, NULL::INT AS oi FROM sp WHERE o = 1
  UNION ALL
  SELECT pk.doc_id, pk.o + 1,
    CASE WHEN fits THEN pk.buf || chr(10) || chr(10) || nt ELSE nt END, CASE WHEN fits THEN bs ELSE ns END, ne,
    CASE WHEN fits THEN prev ELSE whole END, CASE WHEN fits THEN idx ELSE idx + 1 END,
    CASE WHEN fits THEN NULL ELSE whole END, CASE WHEN fits THEN NULL ELSE bs END, CASE WHEN fits THEN NULL ELSE be END, CASE WHEN fits THEN NULL ELSE idx END
  FROM (
    SELECT pk.*, sp.t AS nt, sp.s AS ns, sp.e AS ne, coalesce(length(pk.buf) + 2 + length(sp.t) <= {size}, FALSE) AS fits,
      CASE WHEN {tail} <> '' THEN {tail} || chr(10) || chr(10) || buf ELSE buf END AS whole
    FROM pk LEFT JOIN sp ON sp.doc_id = pk.doc_id AND sp.o = pk.o + 1 WHERE pk.buf IS NOT NULL
  ) pk
),
ch AS (SELECT doc_id, oi AS "index", out AS text, os AS char_start, oe AS char_end FROM pk WHERE out IS NOT NULL)"""


RAW, PARTED = "SELECT doc_id, text FROM documents", "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"
CHUNK_OUT = 'SELECT concat(doc_id, \'#\', "index") AS chunk_id, doc_id::VARCHAR AS source, "index"::INT AS "index", text, char_start::INT AS char_start, char_end::INT AS char_end FROM ch'


def corpus(spark: SparkSession, d: str, parted: bool = False) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")) if parted else F.col("text")
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", text.alias("text"))


def split_rows(df: DataFrame, size: int, overlap: int) -> DataFrame:
    rows = df.select("doc_id", F.posexplode(chunking.split_spans(F.col("text"), size, overlap)).alias("piece", "c"))
    return rows.select("doc_id", "piece", F.col("c.text").alias("text"), F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"))


SPLIT_OUT = "SELECT doc_id, (o - 1)::INT AS piece, t AS text, s::INT AS char_start, e::INT AS char_end FROM sp"


@query(f"WITH RECURSIVE {spans_sql(PARTED, 1000000, 0)} {SPLIT_OUT}")
def para_split(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(corpus(spark, d, True), 1_000_000, 0)


@query(f"WITH RECURSIVE {spans_sql(RAW, 1200, 150)} {SPLIT_OUT}")
def hard_split(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(corpus(spark, d), 1200, 150)


@query(chunks_sql(RAW, 1200, 150) + CHUNK_OUT)
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_corpus(corpus(spark, d))


@query(chunks_sql(PARTED, 1200, 150) + CHUNK_OUT)
def chunk_docs_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_corpus(corpus(spark, d, True))


@query(chunks_sql(PARTED, 200, 60) + 'SELECT concat(doc_id, \'#\', "index") AS chunk_id, concat(\'{"source":"\', doc_id, \'","charStart":\', char_start, \',"charEnd":\', char_end, \'}\') AS metadata FROM ch')
def chunk_ids_metadata(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_corpus(corpus(spark, d, True), 200, 60)
    return made.select("chunk_id", F.to_json(F.struct("source", F.col("char_start").alias("charStart"), F.col("char_end").alias("charEnd"))).alias("metadata"))


CHUNK_BM25 = (
    chunks_sql(RAW, 1200, 150)
    + f""", co AS (SELECT *, concat(doc_id, '#', "index") AS cid, row_number() OVER (ORDER BY doc_id, "index") AS ord FROM ch), {tokens_sql("tok", "co", "ord")},
tf AS (SELECT id, t, count(*) AS tf FROM tok GROUP BY id, t),
len AS (SELECT co.ord AS id, count(tok.t) AS len FROM co LEFT JOIN tok ON tok.id = co.ord GROUP BY co.ord),
st AS (SELECT count(*) AS n, coalesce(nullif(sum(len) / count(*), 0), 1) AS avg_len FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), {tokens_sql("qtok", "benchmark", "item_id")},
q AS (SELECT id AS query_id, t, min(pos) AS p FROM qtok GROUP BY id, t), {bm25_sql()},
best AS (SELECT query_id, doc_id, min(rank) AS best FROM bmr JOIN co ON co.ord = doc_ord WHERE rank <= 50 GROUP BY ALL)"""
)


@query(CHUNK_BM25 + " SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY best))::INT AS rank, doc_id::VARCHAR AS id FROM best")
def chunk_bm25_collapse(spark: SparkSession, d: str) -> DataFrame:
    # Only the order of ordinals counts: document, then place in it.
    made = chunking.chunk_corpus(corpus(spark, d))
    order = F.shiftleft(F.col("source").cast("long"), 20) + F.col("index")
    ordered = kept(made.select("text", order.alias("doc_ord")), "chunks")
    hits = lexical.search(lexical.build_index(ordered), items(spark, d), 50)
    chunk = F.concat(F.shiftright("doc_ord", 20).cast("string"), F.lit("#"), F.col("doc_ord").bitwiseAND(F.lit((1 << 20) - 1)).cast("string"))
    return fusion.collapse(hits.select("query_id", "rank", chunk.alias("id")))


QRELS_SQL = "qrels AS (SELECT item_id AS query_id, doc_id AS doc_ord, (1 + doc_id % 2)::DOUBLE AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Bytes of items that one broadcast may hold.
ITEMS = 8 << 20


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, grade): documents that hold an item. Containment has no key, so every
    document meets the items, in slices of them that are small enough to broadcast."""
    q = items(spark, d)
    total = q.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices, found = max(1, -(-total // (ITEMS // 2))), []
    for i in range(slices):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else q
        found.append(docs(spark, d).join(F.broadcast(part.withColumnRenamed("text", "item")), F.contains("text", "item")))
    held = reduce(DataFrame.unionByName, found)
    return held.select("query_id", F.col("doc_ord").alias("id"), (1 + F.col("doc_ord") % 2).cast("double").alias("grade"))


@query(f"WITH {QRELS_SQL} SELECT query_id, doc_ord AS id, grade FROM qrels")
def qrels_from_containment(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d)


def metric_sql(ranking: str, prefix: str) -> str:
    return f"""{prefix}i AS (SELECT query_id, count(*) AS rel, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_ord) AS r FROM qrels WHERE grade > 0) GROUP BY query_id),
{prefix}f AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) END) AS dcg, min(CASE WHEN rank <= 10 AND grade > 0 THEN rank END) AS first,
  count(CASE WHEN rank <= 10 AND grade > 0 THEN 1 END) AS h10, count(CASE WHEN rank <= 100 AND grade > 0 THEN 1 END) AS h100
  FROM {ranking} JOIN qrels USING (query_id, doc_ord) GROUP BY query_id),
{prefix} AS (SELECT j.query_id, coalesce(dcg / ideal, 0) AS ndcg, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(h10 / rel, 0) AS recall_10, coalesce(h100 / rel, 0) AS recall_100
  FROM (SELECT DISTINCT query_id FROM qrels) j LEFT JOIN {prefix}i i USING (query_id) LEFT JOIN {prefix}f f USING (query_id))"""


BM_METRICS = f"WITH {INDEX}, {bm25_sql()}, {QRELS_SQL}, bm100 AS (SELECT * FROM bmr WHERE rank <= 100), {metric_sql('bm100', 'm')}"


def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranking = lexical.search(lexical.build_index(docs(spark, d)), items(spark, d), 100).withColumnRenamed("doc_ord", "id")
    return metrics.per_query(ranking, kept(qrels(spark, d), "qrels"))


@query(f"{BM_METRICS} SELECT query_id, round(recall_10, 6) AS recall_10, round(recall_100, 6) AS recall_100 FROM m")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return bm25_metrics(spark, d).select("query_id", r6("recall_10").alias("recall_10"), r6("recall_100").alias("recall_100"))


@query(f"{BM_METRICS} SELECT query_id, round(mrr, 6) AS mrr FROM m")
def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return bm25_metrics(spark, d).select("query_id", r6("mrr").alias("mrr"))


@query(f"{BM_METRICS} SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return bm25_metrics(spark, d).select("query_id", r6("ndcg").alias("ndcg"))


CARD = "round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall_10), 6) AS recall_10, round(avg(recall_100), 6) AS recall_100"


def rounded(cards: DataFrame) -> DataFrame:
    return cards.select("method", *[r6(c).alias(c) for c in cards.columns[1:]])


@query(f"{BM_METRICS} SELECT 'BM25' AS method, {CARD} FROM m")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    ranking = lexical.search(lexical.build_index(docs(spark, d)), items(spark, d), 100).withColumnRenamed("doc_ord", "id")
    return rounded(metrics.scorecard("BM25", ranking, kept(qrels(spark, d), "qrels")))


@query(
    f"WITH {INDEX}, {bm25_sql()}, {DENSE}, {FUSED.replace('{pool}', '300')}, {QRELS_SQL}, bmp AS (SELECT * FROM bmr WHERE rank <= 300), drp AS (SELECT * FROM dr WHERE rank <= 300), "
    f"{metric_sql('bmp', 'm1')}, {metric_sql('drp', 'm2')}, {metric_sql('fr', 'm3')} "
    + " UNION ALL ".join(f"SELECT '{n}' AS method, {CARD} FROM m{i}" for i, n in ((1, "BM25"), (2, "dense"), (3, "hybrid")))
)
def method_grid(spark: SparkSession, d: str) -> DataFrame:
    # Rankings and judgments serve several methods: written once.
    near, words = (kept(p, "pool") for p in pools(spark, d, 300))
    return rounded(metrics.grid({"BM25": words, "dense": near, "hybrid": fusion.rrf([near, words])}, kept(qrels(spark, d), "qrels")))


LABELS = "(SELECT a.vec_id AS query_id, b.vec_id AS doc_ord, 1.0::DOUBLE AS grade FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


@query(
    f"WITH {NORMS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_ord, {COS} AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_ord) AS rank FROM s), qrels AS {LABELS}, r100 AS (SELECT * FROM r WHERE rank <= 100), "
    f"{metric_sql('r100', 'm')} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall_100, 6) AS recall_100 FROM m"
)
def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    near = dense.top_k(v, probes(v), 101, DIM).where("ord <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    ranking = near.select("query_id", F.row_number().over(order).alias("rank"), F.col("ord").alias("id")).where("rank <= 100")
    a, b = v.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "label"), v.select(F.col("ord").alias("id"), "label")
    judged = a.join(b, "label").where("id <> query_id").select("query_id", "id", F.lit(1.0).alias("grade"))
    return metrics.per_query(ranking, judged).select("query_id", r6("ndcg").alias("ndcg"), r6("recall_100").alias("recall_100"))


REPLIES = {0: "[3, 0, 1]", 1: "Sure: [2]", 2: "[4, 4, 2]", 3: "[99999999999, 1]"}
BROKEN = {0: "no list here", 1: "[1,,2]", 2: "[007]", 3: "[-1, 2]", 4: "[]", 5: None}


def replied(spark: SparkSession, replies: dict[int, str | None]) -> DataFrame:
    rows = [(q, r, x, x, 1 - r / 10) for q in replies for r, x in enumerate("abcdef", 1)]
    candidates = spark.createDataFrame(rows, "query_id long, rank int, id string, text string, score double")
    asked = spark.createDataFrame([(q, str(q)) for q in replies], "query_id long, text string")
    return rerank.rerank_with(candidates, asked, 3, lambda query, texts: replies[int(query)]).select("query_id", "rank", "id")


def literal_ranks(lists: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, {r}::INT AS rank, '{x}' AS id" for q, ids in enumerate(lists) for r, x in enumerate(ids, 1))


@query(literal_ranks(["dab", "cab", "eca", "bac"]))
def rerank_static_replies(spark: SparkSession, d: str) -> DataFrame:
    return replied(spark, REPLIES)


@query(literal_ranks(["abc"] * len(BROKEN)))
def rerank_fail_open(spark: SparkSession, d: str) -> DataFrame:
    return replied(spark, BROKEN)


@query("SELECT count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM documents")
def store_roundtrip_count(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(
        F.col("doc_ord").cast("string").alias("id"), F.col("doc_ord").alias("chunk_ord"), "text", embedders.hashed(F.col("text"), DIM).alias("embedding"), F.lit(None).cast("string").alias("metadata")
    )
    path = shared_dir(spark, "store")
    ChunkStore(rows).save(path)
    return ChunkStore.load(spark, path).chunks.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, regexp_replace(substr(text, 1, 200), '\\s+', ' ', 'g') AS snippet, substr(text, 1, 800) AS shown FROM documents")
def cli_snippet(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_ord").alias("doc_id"), T.snippet(F.col("text")).alias("snippet"), F.substring("text", 1, rerank.SHOWN).alias("shown"))


@query("SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN url || chr(10) || chr(10) || html ELSE html END AS body FROM pages")
def title_projection(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.body_of(F.col("url"), F.col("html")).alias("body"))


LETTERS = embedders.LetterEmbedder()


def letters_sql(text: str) -> str:
    """The vector of a text, as a list."""
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE" for c in LETTERS.letters) + ", 1.0::DOUBLE]"


def letters_cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


LETTERS_TOPK = f"""WITH v AS (SELECT doc_id AS ord, {letters_sql("coalesce(text, '')")} AS e FROM documents), q AS (SELECT item_id AS query_id, {letters_sql("coalesce(text, '')")} AS e FROM benchmark),
s AS (SELECT query_id, ord, {letters_cos("q.e", "v.e")} AS score FROM q CROSS JOIN v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM s)"""


@query(f"SELECT doc_id, {letters_sql("concat('passage: ', coalesce(text, ''))")}::DOUBLE[] AS embedding FROM documents")
def attach_with_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A task prefix goes before every text that is embedded."""
    made = embedders.attach(docs(spark, d), LETTERS, prefix="passage: ")
    return made.select(F.col("doc_ord").alias("doc_id"), "embedding")


def letter_store(spark: SparkSession, d: str) -> ChunkStore:
    rows = embedders.attach(docs(spark, d), LETTERS)
    return ChunkStore(rows.select(F.concat(F.lit("d"), F.col("doc_ord")).alias("id"), F.col("doc_ord").alias("chunk_ord"), "text", "embedding", F.lit(None).cast("string").alias("metadata")))


@query(f"{LETTERS_TOPK} SELECT query_id, rank::INT AS rank, concat('d', ord) AS id, round(score, 6) AS score FROM r WHERE rank <= 5")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    q = embedders.attach(items(spark, d), LETTERS).select("query_id", "embedding")
    return letter_store(spark, d).search(q, 5).withColumn("score", r6("score"))


@query(f"{LETTERS_TOPK} SELECT query_id, rank::INT AS rank, concat('d', ord) AS id, round(score, 6) AS score FROM r WHERE rank <= 3")
def ask_small_pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool smaller than k truncates the answer."""
    found = pipeline.ask(items(spark, d), letter_store(spark, d), LETTERS, k=5, pool=3)
    return found.select("query_id", "rank", "id", r6("score").alias("score"))


@query(f"WITH {INDEX}, {bm25_sql()} SELECT query_id, rank::INT AS rank, concat('d', doc_ord // 2) AS id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def store_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Two chunks share each id; hits keep it."""
    rows = docs(spark, d).select(
        F.concat(F.lit("d"), F.expr("doc_ord div 2")).alias("id"), F.col("doc_ord").alias("chunk_ord"), "text", F.array(F.lit(1.0)).alias("embedding"), F.lit(None).cast("string").alias("metadata")
    )
    return ChunkStore(rows).keyword_search(items(spark, d), 10).withColumn("score", r6("score"))


@query("SELECT concat('d', g) AS id, text FROM (SELECT doc_id // 2 AS g, text, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def store_last_of_id(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(
        F.concat(F.lit("d"), F.expr("doc_ord div 2")).alias("id"), F.col("doc_ord").alias("chunk_ord"), "text", F.array(F.lit(1.0)).alias("embedding"), F.lit(None).cast("string").alias("metadata")
    )
    return ChunkStore(rows).by_id().select("id", "text")


@query("SELECT 0::BIGINT AS dense, 0::BIGINT AS lexical, 0::BIGINT AS keyword, 0::BIGINT AS empty")
def no_results(spark: SparkSession, d: str) -> DataFrame:
    """k of 0 or less, and an empty index, give no rows."""
    v, q = vectors(spark, d), items(spark, d)
    store = letter_store(spark, d)
    found = {
        "dense": dense.top_k(v, probes(v), 0, DIM), "lexical": lexical.search(lexical.build_index(docs(spark, d)), q, -1), "keyword": store.keyword_search(q, 0),
        "empty": lexical.search(lexical.build_index(docs(spark, d).limit(0)), q, 5),
    }
    counts = [f.agg(F.count("*").alias(name)) for name, f in found.items()]
    return reduce(DataFrame.crossJoin, counts)


@query("SELECT vec_id AS ord, 'v' || vec_id AS id, embedding::DOUBLE[] AS embedding, CASE WHEN vec_id % 3 > 0 THEN concat('{\"label\":', label, '}') END AS metadata FROM embeddings")
def store_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select(
        F.concat(F.lit("v"), F.col("ord")).alias("id"), F.col("ord").alias("chunk_ord"), F.lit("é\n\"x\"").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(F.col("ord") % 3 > 0, F.to_json(F.struct("label"))).alias("metadata"),
    )
    path = f"{shared_dir(spark, 'store')}/store.json"
    ChunkStore(rows).save_json(path)
    again = ChunkStore.load_json(spark, path).chunks
    return again.where(F.col("text") == "é\n\"x\"").select(F.col("chunk_ord").alias("ord"), "id", "embedding", "metadata")


@query("SELECT doc_id::VARCHAR AS _id, CASE WHEN doc_id % 2 = 0 THEN lang END AS title, text FROM documents")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    source = spark.read.parquet(f"{d}/documents.parquet")
    path = shared_dir(spark, "jsonl")
    source.select(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"), "text").write.json(path)
    return read_jsonl(spark, path).select("_id", "title", "text")


@query("SELECT item_id::VARCHAR AS query_id, concat('d', item_id % 7) AS id, 2.0::DOUBLE AS grade FROM benchmark")
def qrels_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated judgments: a header, lines that lack a grade, and pairs judged twice."""
    pair = F.concat_ws("\t", "query_id", F.concat(F.lit("d"), F.col("query_id") % 7))
    lines = F.concat(F.lit("query-id\tcorpus-id\tscore\r\n"), F.array_join(F.array_sort(F.collect_list(F.concat(pair, F.lit("\t1\r\n"), pair, F.lit("\n\n"), pair, F.lit("\t2")))), "\n"))
    path = shared_dir(spark, "qrels")
    items(spark, d).agg(lines.alias("value")).coalesce(1).write.text(path)
    return read_qrels(spark, path)


@query(f"WITH {QRELS_SQL} SELECT item_id AS query_id, b.text IS NULL AS blank FROM benchmark b WHERE item_id IN (SELECT query_id FROM qrels)")
def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that have a judgment."""
    return items(spark, d).join(qrels(spark, d).select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("text").isNull().alias("blank"))


@query("SELECT id, embedding FROM (SELECT 'd' || doc_id AS id, " + letters_sql("coalesce(text, '')") + "::DOUBLE[] AS embedding FROM documents)")
def attach_cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are made once; the second time nothing is embedded."""
    rows = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_ord")).alias("id"), "text")
    path = shared_dir(spark, "vectors")
    embedders.attach_cached(rows, LETTERS, path, key="id")
    return embedders.attach_cached(rows, None, path, key="id").select("id", "embedding")


@query("SELECT json_extract_string(j, '$.method') AS method, round(json_extract(j, '$.mrr')::DOUBLE, 6) AS mrr, 2::BIGINT AS n_methods FROM (VALUES ('{\"method\":\"a\",\"mrr\":0.5}'::JSON), ('{\"method\":\"b\",\"mrr\":0.25}'::JSON)) t(j)")
def result_record(spark: SparkSession, d: str) -> DataFrame:
    """The JSON record of a run, read again."""
    cards = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "method string, mrr double")
    read = json.loads(metrics.record(cards.orderBy("method"), dataset="x"))
    return spark.createDataFrame([(m["method"], m["mrr"], len(read["methods"])) for m in read["methods"]], "method string, mrr double, n_methods long")
