import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedders
from lodestone.operators.rerank import RerankOptions
from lodestone.plans.pipeline import HYBRID, ask, ingest
from lodestone.sources.files import read_jsonl, read_qrels
from lodestone.sources.store import ChunkStore


class Fake:
    """1 for cats, 1 for dogs, and a constant."""

    def embed_batch(self, texts):
        return [[float("cat" in t.lower()), float("dog" in t.lower()), 0.1] for t in texts]


class Handler(BaseHTTPRequestHandler):
    reply = "[1, 0]"
    seen: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen.append((self.path, body, self.headers.get("Authorization")))
        texts = body.get("input", [])
        answers = {
            "/api/embed": {"embeddings": [[float(len(t)), 1.0] for t in texts]},
            "/v1/embeddings": {"data": [{"embedding": [float(len(t)), 2.0]} for t in texts]},
            "/v1/chat/completions": {"choices": [{"message": {"content": self.reply}}]},
        }
        answer = answers.get(self.path)
        self.send_response(200 if answer else 500)
        self.end_headers()
        self.wfile.write(json.dumps(answer or {"error": "x" * 500}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_embedders(spark, server):
    rows = spark.createDataFrame([("a", "xx"), ("b", None)], "chunk_id string, text string")
    local = embedders.attach(rows, embedders.OllamaEmbedder(f"{server}/"), prefix="q: ").orderBy("chunk_id").collect()
    assert [r.embedding for r in local] == [[5.0, 1.0], [3.0, 1.0]]
    hosted = embedders.OpenAICompatEmbedder(f"{server}/v1", "secret")
    assert embedders.one(hosted, "abc") == [3.0, 2.0]
    assert Handler.seen[-1][2] == "Bearer secret" and "secret" not in repr(hosted)
    with pytest.raises(ValueError):
        embedders.OpenAICompatEmbedder(server, "")
    with pytest.raises(RuntimeError, match="500"):
        embedders.OllamaEmbedder(f"{server}/wrong").embed_batch(["x"])
    with pytest.raises(Exception, match="500"):
        embedders.attach(rows, embedders.OllamaEmbedder(f"{server}/wrong")).collect()


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", "cat"), ("b", "dog")], "chunk_id string, text string")
    path = str(tmp_path / "cache")
    first = embedders.attach_cached(rows, Fake(), path).collect()
    assert len(first) == 2 and sorted(map(str, embedders.attach_cached(rows, None, path).collect())) == sorted(map(str, first))


def folder(tmp_path):
    for name, text in {
        "cats.md": "All about cats. " * 3, "dogs.txt": "All about dogs.", "e1234.mdx": "Error E1234: disk full", "e9999.md": "Error E9999: out of memory", "skip.csv": "cats",
    }.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "in.md").write_text("cats")
    return str(tmp_path)


def test_ingest_and_ask(spark, tmp_path, server):
    store = ingest(spark, folder(tmp_path), Fake())
    assert store.size == 4
    q = spark.createDataFrame([(7, "what is E9999")], "query_id long, text string")
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    hybrid = ask(q, store, Fake(), k=2, retrieval=HYBRID)
    assert ids(hybrid)[0] == "e9999.md#0"
    assert ids(ask(q, store, Fake(), k=5, pool=2)) == ["e1234.mdx#0", "e9999.md#0"]
    assert json.loads(hybrid.orderBy("rank").first().metadata)["source"] == "e9999.md"
    dense = ids(ask(q, store, Fake(), k=1))
    options = RerankOptions(f"{server}/v1")
    assert dense == ["e1234.mdx#0"] and ids(ask(q, store, Fake(), k=1, rerank_results=True, rerank_options=options)) == ["e9999.md#0"]
    broken = RerankOptions(f"{server}/nowhere", timeout=2)
    assert ids(ask(q, store, Fake(), k=1, rerank_results=True, rerank_options=broken)) == dense
    assert ids(ask(q, store, Fake(), k=1, rerank_options=options)) == dense


def test_store_round_trips(spark, tmp_path):
    rows = [
        {"id": "a", "text": "x", "embedding": [1, 0, 0, 0], "metadata": {"source": "a", "n": 1}}, {"id": "b", "text": "y", "embedding": [0, 1, 0, 0]},
        {"id": "d", "text": "z", "embedding": [0.9, 0.1, 0, 0]},
    ]
    store = ChunkStore.from_chunks(spark, rows)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    top = lambda s, k: [r.id for r in s.search(q, k).orderBy("rank").collect()]
    assert top(store, 2) == ["a", "d"] and len(top(store, 100)) == 3 and top(store, 0) == []
    store.save_json(str(tmp_path / "deep" / "store.json"))
    again = ChunkStore.load_json(spark, str(tmp_path / "deep" / "store.json"))
    assert again.size == 3 and top(again, 2) == ["a", "d"] and again.built_at == store.built_at
    assert json.loads(again.chunks.where("id = 'a'").first().metadata) == {"source": "a", "n": 1}
    store.save(str(tmp_path / "parquet"))
    assert top(ChunkStore.load(spark, str(tmp_path / "parquet")), 2) == ["a", "d"]
    with pytest.raises(Exception):  # noqa: B017
        ChunkStore.load_json(spark, str(tmp_path / "missing.json")).size  # noqa: B018
    same = ChunkStore.from_chunks(spark, [{"id": "a", "text": "old", "embedding": [1]}, {"id": "a", "text": "new", "embedding": [1]}])
    assert [r.text for r in same.by_id().collect()] == ["new"]
    words = spark.createDataFrame([(0, "new old")], "query_id long, text string")
    assert same.keyword_search(words, 5).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\r\n1\ta\t1\r\n1\ta\t2\n2\tb\n\n3\tc\t0\n")
    assert {(r.query_id, r.id, r.grade) for r in read_qrels(spark, str(tmp_path / "q.tsv")).collect()} == {("1", "a", 2.0), ("3", "c", 0.0)}
    (tmp_path / "d.jsonl").write_text('{"_id": "1", "text": "x"}\n\n{"_id": "2", "title": "t", "text": "y"}\n')
    assert [(r._id, r.title) for r in read_jsonl(spark, str(tmp_path / "d.jsonl")).orderBy("_id").collect()] == [("1", None), ("2", "t")]


def test_streaming(spark, tmp_path):
    from lodestone.streaming.ingest import stream_chunks

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("cats and dogs")
    out = str(tmp_path / "out")
    for _ in range(2):
        stream_chunks(spark, str(source), Fake(), out, str(tmp_path / "check")).awaitTermination(60)
        (source / "b.txt").write_text("more dogs")
    assert {r.chunk_id for r in spark.read.parquet(out).collect()} == {"a.md#0", "b.txt#0"}


def test_hashed(spark):
    row = spark.range(1).select(embedders.hashed(F.lit("cat cat dog"), 8).alias("v"), embedders.hashed(F.lit(None).cast("string"), 8).alias("n")).first()
    assert sum(row.v) == 3 and max(row.v) >= 2 and row.n == [0.0] * 8
