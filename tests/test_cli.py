"""The command line with an embedding model, with one that fails, and its settings."""

import json

import pytest

from threadloom import config as settings
from threadloom.__main__ import run
from threadloom.operators.sessions import enclosing_repo
from threadloom.operators.vectors import HashingEmbedder
from threadloom.sources import embedding_services as services


def turn(session, role, text, cwd):
    return json.dumps({"type": role, "timestamp": "2026-01-02T00:00:00Z", "sessionId": session, "cwd": cwd, "message": {"role": role, "content": text}})


@pytest.fixture
def base(tmp_path, monkeypatch):
    for name in ("THREADLOOM_CONFIG", "THREADLOOM_EMBEDDING_PROVIDER", "VOYAGE_API_KEY", "THREADLOOM_STORE"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("HOME", str(tmp_path))
    repo = tmp_path / "code" / "engine"
    (repo / ".git").mkdir(parents=True)
    (repo / "src" / "deep").mkdir(parents=True)
    folder = tmp_path / "claude" / "-x"
    folder.mkdir(parents=True)
    for n, text in enumerate(("fix the parser of dates now", "paint the shed green today")):
        lines = [turn(f"s{n}", "user", text, str(repo / "src" / "deep")), turn(f"s{n}", "assistant", f"done with {text}", str(repo / "src" / "deep"))]
        (folder / f"{n}.jsonl").write_text("\n".join(lines) + "\n")
    return ["--store", str(tmp_path / "store"), "--claude-root", str(tmp_path / "claude"), "--codex-root", str(tmp_path / "no"), "--pi-root", str(tmp_path / "no")]


def test_hybrid_search_and_failing_model(spark, base, monkeypatch, capsys):
    monkeypatch.setenv("THREADLOOM_EMBEDDING_PROVIDER", "hashing")
    run([*base, "sync", "--json"], spark)
    made = json.loads(capsys.readouterr().out)
    assert made["embedded_chunks"] == 2 and made["semantic_status"] == "ready"
    run([*base, "search", "shed", "--json"], spark)
    out = json.loads(capsys.readouterr().out)
    by = {r["native_id"]: r for r in out}
    assert out[0]["native_id"] == "s1" and set(by) == {"s0", "s1"} and all(r["vector_score"] for r in out)  # one of them by its vector alone
    assert by["s0"]["keyword_score"] is None and by["s0"]["repo"] == "engine"

    def broken(self, texts, input_type="document"):
        raise RuntimeError("the model is gone")

    monkeypatch.setattr(HashingEmbedder, "embed", broken)
    run([*base, "search", "parser", "--json"], spark)
    told = capsys.readouterr()
    rows = json.loads(told.out)
    assert [r["native_id"] for r in rows] == ["s0"] and rows[0]["vector_score"] is None and "the model is gone" in told.err


def test_no_service(spark, base, monkeypatch, capsys):
    monkeypatch.setattr(services.LlamaServerEmbedder, "ready", lambda self: (False, "not there"))
    run([*base, "sync"], spark)
    assert "semantic_status: not_ready" in capsys.readouterr().out
    run([*base, "search", "parser"], spark)
    told = capsys.readouterr()
    assert "fix the parser" in told.out and "not there" in told.err


def test_settings(tmp_path, monkeypatch):
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"default_limit": 7, "chunk_tokens": 100, "roots": {"pi": False, "codex": ["/c"]}, "embeddings": {"provider": "voyage", "batch_size": 5}}))
    monkeypatch.setenv("THREADLOOM_CHUNK_TOKENS", "200")
    monkeypatch.setenv("THREADLOOM_CLAUDE_ROOTS", "/a:/b")
    monkeypatch.setenv("THREADLOOM_REDACT", "no")
    monkeypatch.setenv("VOYAGE_API_KEY", "secret")
    c = settings.load(str(file))
    assert (c.default_limit, c.chunk_tokens, c.roots) == (7, 200, {"claude": ("/a", "/b"), "codex": ("/c",), "pi": ()})
    assert (c.embeddings.provider, c.embeddings.batch_size, c.embeddings.redact_before_send, c.embeddings.configured) == ("voyage", 5, False, True)
    assert "secret" not in json.dumps(c.shown())
    file.write_text('{"colour": 1}')
    with pytest.raises(ValueError, match="colour"):
        settings.load(str(file))
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "none.json"))


def test_llama_server():
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, body))
        return 200, json.dumps({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]})

    e = services.LlamaServerEmbedder("m", 2, "host:9", post)
    assert e.embed(["a", "b"]).tolist() == [[1, 2], [3, 4]] and sent[0][0] == "http://host:9/v1/embeddings" and e.model_key == "llama:m"
    assert e.ready(lambda u, t: (200, "")) == (True, "") and not e.ready(lambda u, t: (503, ""))[0]


def test_enclosing_repo(spark):
    exists = {"/home/me/app/.git"}.__contains__
    df = spark.createDataFrame([("/home/me/app/src/x",), ("/home/me/app",), ("/tmp/y/",), ("(unknown)",), (None,)], "cwd string")
    got = [r[0] for r in df.select(enclosing_repo(exists)("cwd")).collect()]
    assert got[:3] == ["app", "app", "y"] and got[4] is None
