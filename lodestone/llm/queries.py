"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, embeddings, language, mixing, near, quality, scoring, substring, suffix, warc
from lodestone.llm.common import fold, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a smaller document go. Null texts are empty; equal
    ids don't remove each other's bytes."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts, learned from those whose fold isn't 2. Null texts are
    empty; a null doc_id is an ordinary row."""
    found = scoring.score(table(spark, sf_dir, "documents"), fold() % 7 != 2)
    return found.withColumn("held_out", fold() % 7 == 2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and benchmark item the most similar window of 0.75 or more. Blank texts
    and items match nothing."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archive. Null html is an empty payload; rows of
    equal page_id are records of their own."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("record_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score, learned from labels whose fold isn't 1. Texts without words get the bias."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold() % 3 != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (fold() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from those whose fold isn't 2. Texts without letters are und."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs.where(fold() % 4 != 2)))
    return found.select("doc_id", (fold() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more, and components. Null, zero and non-finite vectors have none."""
    return embeddings.group(table(spark, sf_dir, "embeddings"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that start anywhere else go. Null texts have no words."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", found["kept"].alias("kept_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. A null source is the last; null texts have size 0."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.75 or more. Blank texts link with nothing."""
    return near.group(table(spark, sf_dir, "documents")).drop("doc", "key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM w) WHERE first_id < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
o AS (
  SELECT d.doc_id, any_value(x) AS x, sum(b - a) AS n_removed, count(a) AS n_spans, coalesce(max(b), 0) AS last,
    coalesce(string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS kept FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(concat(kept, substr(x, 2 * last + 1)))) AS kept_sha256 FROM o
"""

OP3_SQL = """
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS no, text FROM documents UNION ALL
  SELECT 'i', item_id, row_number() OVER (), text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), w AS (
  SELECT kind, id, no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM t
), s AS (
  SELECT kind, id, no, len(w) - 4 AS n, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)
), m AS (SELECT id AS item_id, no AS item, n AS m, g, count(*) AS c FROM s WHERE kind = 'i' GROUP BY ALL),
c AS (
  SELECT DISTINCT d.id, d.no, d.n, item_id, item, m, least(m, d.n) AS size, unnest(range(greatest(0, i - least(m, d.n) + 1), least(i, d.n - least(m, d.n)) + 1)) AS a
  FROM s d JOIN m ON d.g = m.g WHERE d.kind = 'd'
), x AS (
  SELECT c.id, c.no, item_id, item, m, size, a, s.g, count(*) AS n FROM c JOIN s ON s.kind = 'd' AND s.no = c.no AND s.i BETWEEN a AND a + size - 1 GROUP BY ALL
), y AS (
  SELECT id, no, x.item_id, x.item, x.m, size, a, sum(least(n, c))::DOUBLE AS shared FROM x JOIN m ON m.item = x.item AND m.g = x.g GROUP BY ALL
), z AS (
  SELECT id AS doc_id, no, item_id, item, a AS start, size + 4 AS n_words, shared / (size + m - shared) AS similarity FROM y UNION ALL
  SELECT d.id, d.no, i.id, i.no, a, len(i.w), 1.0::DOUBLE FROM (SELECT *, unnest(range(0, len(w))) AS a FROM w WHERE kind = 'd') d
  JOIN w i ON i.kind = 'i' AND len(i.w) BETWEEN 1 AND 4 AND d.w[a + 1:a + len(i.w)] = i.w
)
SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, similarity FROM z WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY no, item ORDER BY similarity DESC, start) = 1
"""

OP4_SQL = """
WITH r AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM r)
SELECT page_id, n::BIGINT AS payload_bytes,
  translate(concat({parts}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  TRUE AS verified
FROM f
""".replace("{parts}", ", ".join(f"to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8)))

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (
  SELECT w.*, max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.i = r.i
), k AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9_SQL = """
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM s GROUP BY source
), c AS (
  SELECT *, 2.0 * source_size AS bound, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM g
), l AS (
  SELECT *, (budget - (sum(bound) OVER u - bound)) / (sum(w) OVER () - (sum(w) OVER u - w)) AS level, bound / w AS ratio
  FROM c WINDOW u AS (ORDER BY bound / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, budget, least(bound, coalesce(w * max(CASE WHEN level <= ratio THEN level END) OVER (), bound)) AS target FROM l
), q AS (
  SELECT s.*, t.source_size, t.budget, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS queued
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, (queued + round * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS v(round) WHERE size > 0
), a AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, o, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM r
), k AS (SELECT doc_id, sum(size) AS taken FROM a WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""


OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_warc": OP4_SQL, "op7_cover_tree": OP7_SQL, "op8_substring": OP8_SQL, "op9_mix_sources": OP9_SQL, "op10_minhash": OP10_SQL}
