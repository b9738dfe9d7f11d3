import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, lexical, metrics
from lodestone.operators.order import numbered
from lodestone.session import shared_dir
from lodestone.sources.files import read_f32, read_qrels


def test_numbered(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 40), i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.col("a"), F.col("b")], "n", 7).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(300))
    assert numbered(spark.createDataFrame([], "a int"), [F.col("a")], "n").count() == 0


def test_top_k_of_ragged_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5]), (2, [1.0, 1.0, 1.0]), (3, []), (4, None), (5, [0.0, 0.0]), (6, [2.0, 0.1])], "ord long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 1.0, 0.0]), (3, [])], "query_id long, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r.rank, r.ord, r.score if r.score is None else round(r.score, 9)) for r in df.collect())
    usable = vectors.where("embedding is not null")
    for k in (1, 3, 10):
        assert rows(dense.top_k_any(usable, queries, k)) == rows(dense.top_k_sql(usable, queries, k))
    assert dense.top_k_any(vectors, queries, 0).count() == 0


def test_kept_index(spark):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, None), (2, "the"), (3, "beta")], "doc_ord long, text string")
    index = lexical.build_index(docs).kept()
    assert {(r.term, r.doc_ord, r.tf, r.len, r.df) for r in index.postings.collect()} == {("alpha", 0, 1, 3, 1), ("beta", 0, 2, 3, 2), ("beta", 3, 1, 1, 2)}
    assert index.size == 4 and index.stats.first().avg_len == 1.0


def test_matrix_file(spark, tmp_path):
    values = [[1.5, -2.0, 0.25], [3.0, 4.0, 5.0]]
    (tmp_path / "m.f32").write_bytes(struct.pack("<I", 3) + b"".join(struct.pack("<3f", *v) for v in values))
    assert [list(r.embedding) for r in read_f32(spark, str(tmp_path / "m.f32")).orderBy("ord").collect()] == values


def test_judgments_of_several_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("q\td\tscore\n1\ta\t1\n")
    (tmp_path / "b.tsv").write_text("q\td\tscore\r\n2\tb\t0.5\r\n2\tc\tx\n")
    got = {(r.query_id, r.id, r.grade) for r in read_qrels(spark, str(tmp_path)).collect()}
    assert got == {("1", "a", 1.0), ("2", "b", 0.5), ("2", "c", None)}


def test_record(spark):
    cards = spark.createDataFrame([("a", 0.123456)], "method string, ndcg double")
    assert json.loads(metrics.record(cards, dataset="x")) == {"dataset": "x", "methods": [{"method": "a", "ndcg": 0.123456}]}


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": lambda self, *_: None})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")
