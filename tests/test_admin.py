import json

import pytest

from threadloom.config import Config, Embeddings
from threadloom.operators.store import Store
from threadloom.operators.vectors import HashingEmbedder
from threadloom.plans import admin
from threadloom.schemas import TABLES
from threadloom.sources import embedding_services as services


def test_migrations_and_report(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert admin.migrate(store, "now") == ["001_init", "002_semantic"] and admin.migrate(store, "later") == []
    assert admin.applied(store) == ["001_init", "002_semantic"] and all(store.version(t) for t in TABLES)
    got = {r["item"]: r["value"] for r in admin.report(store).collect()}
    assert got["sessions"] == "0" and got["semantic"] == "keyword only"
    admin.ensure_width(store, 4)
    with pytest.raises(ValueError):
        admin.ensure_width(store, 0)


def test_query_cache(spark, tmp_path):
    class Counted(HashingEmbedder):
        calls = 0

        def embed(self, texts, input_type="document"):
            type(self).calls += 1
            return super().embed(texts, input_type)

    store, e = Store(spark, str(tmp_path / "s")), Counted(8)
    assert admin.embed_query(store, e, "find it") == admin.embed_query(store, e, "find it") and Counted.calls == 1


def test_transcripts_and_links(spark, tmp_path):
    contents = spark.createDataFrame([("/b", "B"), ("/a", "A")], "path string, content string")
    links = spark.createDataFrame([("u", "/a"), ("u", "/b"), ("v", "/x")], "uid string, path string")
    assert [tuple(r) for r in admin.merged_transcripts(contents, links).collect()] == [("u", "# /a\n\nA\n\n# /b\n\nB")]
    store = Store(spark, str(tmp_path / "s"))
    kinds = spark.createDataFrame([], TABLES["sources"]).schema
    store.write("sources", spark.createDataFrame([("/a", "pi", 1, 1.0, "h", "t", "t", None)], kinds))
    assert [tuple(r) for r in admin.relink(store, links).collect()] == [("u", "/a")]
    lines = spark.createDataFrame([("p", 1, "x", True), ("p", 2, "{}", False), ("p", 3, "[]", False)], "path string, line_no int, raw string, is_bad boolean")
    assert [tuple(r) for r in admin.first_records(lines).collect()] == [("p", "{}")]


@pytest.mark.parametrize(("count", "selected", "visible", "want"), [(10, 0, 4, (0, 4)), (10, 5, 4, (3, 7)), (10, 9, 4, (6, 10)), (2, 1, 4, (0, 2)), (0, 0, 4, (0, 0))])
def test_window(count, selected, visible, want):
    assert admin.result_window(count, selected, visible) == want


def test_services():
    for address in ("127.0.0.1:11434", "http://127.0.0.1:11434/api/embed", "http://127.0.0.1:11434/api", "http://127.0.0.1:11434/"):
        assert services.base_url(address) == "http://127.0.0.1:11434"
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, body, headers))
        if "fail" in body["input"][0]:
            return 500, json.dumps({"error": {"message": "no"}})
        return 200, json.dumps({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]})

    e = services.OllamaEmbedder("embeddinggemma", 2, "host:1", post)
    assert e.embed(["a", "b"], "query").tolist() == [[1, 2], [3, 4]] and e.model_key == "ollama:embeddinggemma"
    assert sent[0][0] == "http://host:1/api/embed" and sent[0][1]["input"][0] == "task: search result | query: a"
    with pytest.raises(services.ServiceError, match="no"):
        e.embed(["fail"])
    with pytest.raises(ValueError):
        services.OllamaEmbedder("m", 3, "h", post).embed(["a", "b"])
    v = services.VoyageEmbedder("voyage-code-3", 2, "key", post=post)
    assert v.embed(["a", "b"]).shape == (2, 2) and sent[-1][2] == {"Authorization": "Bearer key"}
    assert e.ready(lambda u, t: (200, json.dumps({"models": [{"name": "embeddinggemma:latest"}]}))) == (True, "")
    assert not e.ready(lambda u, t: (200, "{}"))[0]
    assert services.with_prefix("x", "query", "Qwen3-Embedding").startswith("Instruct: ")


def test_settings(monkeypatch):
    assert Embeddings("local").provider == "ollama" and Embeddings().model_key.startswith("llama:hf:")
    assert not Embeddings("voyage").configured and Embeddings("voyage", api_key="k").model_key == "voyage-code-3"
    assert isinstance(services.make_embedder(Embeddings("ollama")), services.OllamaEmbedder)
    with pytest.raises(services.ServiceError):
        services.make_embedder(Embeddings("voyage"))
    with pytest.raises(ValueError):
        Embeddings("other")
    assert Config().chunk_tokens == 512
    from threadloom.config import env_flag, env_int, env_text

    monkeypatch.setenv("X_FLAG", "Yes")
    monkeypatch.setenv("X_INT", "12")
    monkeypatch.setenv("X_EMPTY", " ")
    assert (env_flag("X_FLAG"), env_int("X_INT"), env_text("X_EMPTY"), env_flag("X_NONE")) == (True, 12, None, None)
