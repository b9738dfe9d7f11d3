import random

from test_operators import VOCABULARY, corpus

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    bad = [(i, " ".join(rng.choice(VOCABULARY).upper() + "!!" for _ in range(50))) for i in range(200, 260)]
    item = " ".join(rng.choice(VOCABULARY) for _ in range(30))
    shared = " ".join(rng.choice(VOCABULARY) for _ in range(50))
    good = [(300 + i, " ".join(rng.choice(VOCABULARY) for _ in range(80))) for i in range(40)]
    rows = [*corpus(), *bad, *good, (400, f"{good[0][1]} {item}"), (401, f"{shared} {good[1][1][:200]} one"), (402, f"{good[2][1][:150]} two {shared}"), (None, None)]
    rows.append(rows[0])
    d = str(tmp_path)
    cells = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(cells, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 260), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, d), "test")
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert not {i for i, _ in bad} & set(seen[0]) and {i for i, _ in good} <= set(seen[0])
    assert seen[1].keys() <= seen[0].keys() and len(seen[1]) < len(seen[0])
    assert shared not in seen[2][401] and seen[2][401].endswith(" one") and shared not in seen[2].get(402, "")
    assert 400 in seen[2] and 400 not in seen[3] and seen[3].keys() == seen[2].keys() - {400}
    result = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in result} <= set(seen[3]) and all(0 < r.taken <= 2 * r.size for r in result)


CLASHING = "doc_id long, text string, lang string, source string, n_chars int, `kept` string, n_words int, n_removed string, _row_key long, key int, doc string, shard int, `row` int, `a.b` int, spans int"


def written(spark, folder, rows, schema=CLASHING, labels=(), items=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_with_clashing_columns_and_nulls(spark, tmp_path):
    rng = random.Random(1)
    words = lambda k: " ".join(rng.choice(VOCABULARY) for _ in range(k))
    shared = words(40)
    texts = [words(50), f"{shared} {words(9)}", f"{words(9)} {shared}", shared, None, "", " \t", "x", words(20_000), None, "x"]
    rest = (7, 8, "r", 9, 1, "d", 2, 3, 4, 5)
    rows = [(i if i != 9 else None, t, None, None if i % 2 else "s", i, "k", *rest[1:2], *rest[2:]) for i, t in enumerate(texts)]
    docs = written(spark, str(tmp_path), rows, labels=[(i, 1, None) for i in range(10)] + [(None, None, None), (0, None, 1)], items=[(None, None), (1, ""), (2, words(30))])
    columns, kinds = docs.columns, docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == kinds, name
        got = {r.doc_id: r for r in out.collect()}
        assert all(got[i].asDict() | {"text": 0, "n_chars": 0} == dict(zip(columns, rows[i], strict=True)) | {"text": 0, "n_chars": 0} for i in got if i is not None), name
        if stage is corpus_pipeline.substring_stage:
            assert 3 not in got and shared not in got[1].text and got[1].n_chars == len(got[1].text) and got[0].text == texts[0] and got[4].text is None
            assert got[6].text == " \t" and set(got) == {0, 1, 2, 4, 5, 6, 7, 8, 10, None} and got[8].text == texts[8]
        if stage is corpus_pipeline.near_stage:
            assert set(got) == {0, 1, 4, 5, 6, 7, 8, None}
    assert {r.doc_id for r in corpus_pipeline.mix_stage(spark, docs, "").collect()} <= {i for i, t in enumerate(texts) if t and t.split()}


def test_stages_of_empty_tables(spark, tmp_path):
    docs = written(spark, str(tmp_path), [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
