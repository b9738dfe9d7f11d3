import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, fusion, lexical, metrics
from lodestone.operators.rerank import order_of

CATS = "cats are small domesticated felines that purr"
DOGS = "dogs are loyal domesticated canines that bark"


def corpus(spark):
    rows = [(0, CATS), (1, DOGS), (2, "error code E1234 means the disk is full"), (3, "cats " + "filler word " * 100)]
    return lexical.build_index(spark.createDataFrame(rows, "doc_ord long, text string"))


def found(spark, index, text, k=10, **options):
    q = spark.createDataFrame([(0, text)], "query_id long, text string")
    return [r.doc_ord for r in lexical.search(index, q, k, **options).orderBy("rank").collect()]


def test_bm25(spark, tmp_path):
    index = corpus(spark)
    assert found(spark, index, "what does E1234 mean") == [2]
    assert found(spark, index, "cats") == found(spark, index, "cats cats") == [0, 3]
    assert found(spark, index, "zebra") == found(spark, index, "domesticated", 0) == []
    assert found(spark, index, "domesticated", 1) == [0]
    assert found(spark, index, "domesticated purr") == [0, 1]
    # equal scores: the first term of the query that matches decides
    assert found(spark, index, "bark purr") == [1, 0] and found(spark, index, "purr bark") == [0, 1]
    index.save(str(tmp_path / "index"))
    assert found(spark, lexical.Bm25Index.load(spark, str(tmp_path / "index")), "cats") == [0, 3]
    empty = lexical.build_index(spark.createDataFrame([], "doc_ord long, text string"))
    assert found(spark, empty, "cats") == [] and empty.size == 0


def test_empty_documents_count(spark):
    index = lexical.build_index(spark.createDataFrame([(0, "cat"), (1, ""), (2, None)], "doc_ord long, text string"))
    stats = index.stats.first()
    assert (stats.n, stats.avg_len) == (3, 1 / 3)
    assert lexical.build_index(spark.createDataFrame([(0, "the")], "doc_ord long, text string")).stats.first().avg_len == 1


def test_cosine(spark):
    pairs = [([1, 0], [1, 0]), ([1, 0], [0, 1]), ([1, 0], [-1, 0]), ([0, 0], [1, 1]), ([], [1]), ([3, 4, 9], [3, 4])]
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b in pairs], "a array<double>, b array<double>")
    assert [r.c for r in df.select(dense.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, -1, 0, 0, 1]


def test_dense_top_k_agrees(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[7] = x[3]
    x[9] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ord long, embedding array<double>")
    q = v.where("ord < 8").select(F.col("ord").alias("query_id"), "embedding")
    rows = lambda df: [(r.query_id, r.rank, r.ord, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(dense.top_k(v, q, 5, 4)) == rows(dense.top_k_sql(v, q, 5))
    assert dense.top_k(v, q, 0, 4).count() == dense.top_k_sql(v, q, 0).count() == 0
    assert dense.top_k(v, q, 100, 4).count() == 8 * 60
    assert "WindowGroupLimit" in dense.top_k_sql(v, q, 5)._jdf.queryExecution().executedPlan().toString()


def test_dense_top_k_sql_by_columns(spark, monkeypatch):
    """As pair by pair, though scores come from columns and only what reaches a bound is sorted."""
    rng = np.random.default_rng(1)
    x = [r.tolist() for r in np.round(rng.normal(size=(400, 5)), 1)]
    for i in range(100, 160):
        x[i] = x[3]
    x[9], x[10], x[50] = [0.0] * 5, [1e-170] * 5, [1e160] * 5
    odd = {20: [1.0, 0.5], 21: [], 22: None, 23: [1.0, None, 0.0, 0.0, 1.0], 24: [float("nan")] * 5, 25: [float("inf"), 1.0, 0.0, 0.0, 0.0], 26: [1.0] * 9}
    rows = lambda df: sorted((r.query_id, r.rank, r.ord, repr(None if r.score is None else round(r.score, 9) + 0.0)) for r in df.collect())
    v = spark.createDataFrame([(i, odd.get(i, r)) for i, r in enumerate(x)], "ord long, embedding array<double>")
    q = v.where("ord < 30 or ord = 50").select(F.col("ord").alias("query_id"), "embedding")
    for k, size in ((7, 400), (500, 32 << 20)):
        monkeypatch.setattr(dense, "SLICE", size)
        assert rows(dense.top_k_sql(v, q, k)) == rows(dense.top_k_pairs(v, q, k))
    v = spark.createDataFrame(list(enumerate(x)), "ord long, embedding array<double>")
    q = v.where("ord < 30").select(F.col("ord").alias("query_id"), "embedding")
    plan = dense.top_k_sql(v, q, 7)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "CartesianProduct" not in plan and ">= least" in plan
    assert dense.top_k_sql(v, q.limit(0), 7).count() == dense.top_k_sql(v.limit(0), q, 7).count() == 0


def test_dense_top_k_sql_of_long_vectors(spark):
    x = np.random.default_rng(2).normal(size=(60, 130))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ord long, embedding array<double>")
    q = v.where("ord < 5").select(F.col("ord").alias("query_id"), "embedding")
    rows = lambda df: sorted((r.query_id, r.rank, r.ord, round(r.score, 9)) for r in df.collect())
    assert rows(dense.top_k_sql(v, q, 5)) == rows(dense.top_k(v, q, 5, 130))


def ranked(spark, *lists):
    return [spark.createDataFrame([(0, i, x) for i, x in enumerate(ids, 1)], "query_id long, rank int, id string") for ids in lists]


def test_rrf_and_collapse(spark):
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(fusion.rrf(ranked(spark, "abc", "bda"))) == ["b", "a", "d", "c"]
    assert ids(fusion.rrf(ranked(spark, "ab", "ba"))) == ["a", "b"]
    assert ids(fusion.rrf(ranked(spark, "a", "b"), weights=[1, 3])) == ["b", "a"]
    assert {r.id: round(r.score, 9) for r in fusion.rrf(ranked(spark, "xxy")).collect()} == {"x": round(1 / 61, 9), "y": round(1 / 63, 9)}
    assert ids(fusion.collapse(ranked(spark, ["d#1", "e#0", "d#0", "f#2"])[0])) == ["d", "e", "f"]


def test_metrics(spark):
    def card(ranking, judged, cuts):
        r = spark.createDataFrame([(0, i, x) for i, x in enumerate(ranking, 1)], "query_id long, rank int, id string")
        j = spark.createDataFrame([(0, x, float(g)) for x, g in judged.items()], "query_id long, id string, grade double")
        return metrics.per_query(r, j, cuts).first()

    two = {"d1": 1, "d2": 1}
    assert card(["d1", "x", "y"], two, (3,)).recall_3 == 0.5
    assert card(["x", "d2", "d1"], two, (3,)).recall_3 == 1 and card(["x", "d2", "d1"], two, (1,)).recall_1 == 0
    assert card(["x", "y", "d2"], two, (10,)).mrr == pytest.approx(1 / 3) and card(["x", "y", "d2"], two, (2,)).mrr == 0
    assert card(["d1", "d2", "x"], two, (10,)).ndcg == pytest.approx(1)
    assert card(["x", "d1"], two, (10,)).ndcg == pytest.approx(0.386852807)
    assert card(["lo", "hi"], {"hi": 2, "lo": 1}, (2,)).ndcg == pytest.approx(0.8597187)
    assert card(["d1"], {"d1": 0}, (10,)).ndcg == 0
    # a judged query without a ranking counts as 0 in the mean
    r = spark.createDataFrame([(0, 1, "a")], "query_id long, rank int, id string")
    j = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "query_id long, id string, grade double")
    assert metrics.scorecard("m", r, j).first().mrr == 0.5
    assert "| m | 0.500 |" in metrics.markdown(metrics.scorecard("m", r, j))
    assert metrics.mean(spark.createDataFrame([], "x double"), "x").first()[0] == 0
    late = spark.createDataFrame([(0, "a", 1.0, 1), (0, "a", 3.0, 2)], "query_id long, id string, grade double, line int")
    assert metrics.latest(late, "line").first().grade == 3


@pytest.mark.parametrize(
    ("reply", "k", "expected"),
    [
        ("[3, 0, 1]", 3, "dab"), ("[2]", 3, "cab"), ("[4, 4, 2]", 3, "eca"), ("[99999999999, 1]", 3, "bac"), ("no list", 3, "abc"), ("[1,,2]", 3, "abc"),
        ("[007]", 3, "abc"), ("[-1, 2]", 3, "abc"), ("[]", 3, "abc"), (None, 3, "abc"), (["x"], 3, "abc"), ("[1]", 0, "b"), ("x", 0, ""),
    ],
)
def test_rerank_replies(reply, k, expected):
    assert "".join("abcdef"[i] for i in order_of(reply, 6, k)) == expected


def test_rerank_few_candidates():
    assert order_of("[2, 1, 0]", 3, 5) == [0, 1, 2]
