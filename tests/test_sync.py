import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.config import Config, Embeddings
from threadloom.operators.sessions import normalize
from threadloom.operators.store import Store
from threadloom.operators.vectors import HashingEmbedder
from threadloom.plans.search import Context, Corpus, search
from threadloom.plans.sync import run_sync
from threadloom.sources import transcripts
from threadloom.streaming.watch import watch

U1, U2 = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"
T = "2026-06-20T12:00:00Z"


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


@pytest.fixture
def roots(tmp_path):
    claude, codex, pi = (tmp_path / n for n in ("claude", "codex", "pi"))
    put(
        claude / "-w-app" / f"{U1}.jsonl",
        {"type": "user", "timestamp": "2026-06-01T00:00:01Z", "sessionId": U1, "gitBranch": "main", "message": {"role": "user", "content": "Hi, fix the parser. Thanks"}},
        "",
        {"type": "assistant", "timestamp": "2026-06-01T00:00:02Z", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "Done"}, {"type": "tool_use"}]}},
        {"type": "ai-title", "aiTitle": "First"},
        {"type": "ai-title", "aiTitle": "Parser fix"},
        {"type": "system", "entrypoint": "vscode"},
    )
    put(claude / "-w-app" / "deep" / "skip.jsonl", {"type": "user"})
    put(
        codex / "2026" / "rollout-a.jsonl",
        {"type": "session_meta", "timestamp": "2026-06-02T00:00:00Z", "payload": {"id": "c1", "cwd": "/w/site", "source": "vscode", "thread_name": "Old"}},
        {"type": "turn_context", "payload": {"model": "g5"}},
        {"type": "event_msg", "payload": {"type": "thread_name_updated", "thread_name": "New name"}},
        {"type": "response_item", "timestamp": "2026-06-02T00:00:03Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "deploy it"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "system", "content": "no"}},
    )
    put(codex / "other.jsonl", {"type": "session_meta"})
    put(
        pi / "a.jsonl",
        {"type": "session", "id": "p1", "cwd": "/w/agent-view/x", "timestamp": "2026-06-03T00:00:00Z"},
        {"type": "model_change", "modelId": "k1"},
        {"type": "message", "timestamp": "2026-06-03T00:00:05Z", "message": {"role": "user", "content": "second"}},
        {"type": "model_change"},
        {"type": "message", "timestamp": "2026-06-03T00:00:06Z", "message": {"role": "assistant", "content": "reply"}},
    )
    put(pi / "b.jsonl", {"type": "session", "id": "p1"}, {"type": "message", "timestamp": "2026-06-03T00:00:01Z", "message": {"role": "user", "content": "first"}})
    put(pi / "run-history.jsonl", {"type": "session", "id": "no"})
    put(pi / "bad.jsonl", "not json", {"type": "session", "id": "bad"})
    return {"claude": [str(claude)], "codex": [str(codex)], "pi": [str(pi)]}


def parsed(spark, roots):
    files = transcripts.discover(spark, roots)
    return transcripts.parse_files(transcripts.contents(spark, roots, files))[0]


def test_discovery(spark, roots):
    names = {os.path.basename(r["path"]) for r in transcripts.discover(spark, roots).collect()}
    assert names == {f"{U1}.jsonl", "rollout-a.jsonl", "a.jsonl", "b.jsonl", "bad.jsonl"}
    assert transcripts.discover(spark, {"pi": ["/nowhere"]}).count() == 0


def test_parse(spark, roots):
    got = {(r["provider"], os.path.basename(r["path"])): r for r in parsed(spark, roots).collect()}
    c = got["claude", f"{U1}.jsonl"]
    assert (c["native_id"], c["cwd"], c["branch"], c["surface"], c["title"]) == (U1, "/w/app", "main", "ide", "Parser fix")
    assert [t["text"] for t in c["turns"]] == ["Hi, fix the parser. Thanks", "Done"] and c["models"] == ["m1"]
    x = got["codex", "rollout-a.jsonl"]
    assert (x["native_id"], x["surface"], x["title"], x["models"]) == ("c1", "ide", "New name", ["g5"])
    assert [t["role"] for t in x["turns"]] == ["user"] and x["created_at"] == "2026-06-02T00:00:00Z"
    p = got["pi", "a.jsonl"]
    assert p["is_subagent"] and p["surface"] == "subagent" and [t["model"] for t in p["turns"]] == ["k1", None]
    bad = got["pi", "bad.jsonl"]
    assert bad["native_id"] == "bad" or bad["turns"] == [] and len(bad["warnings"]) == 1


def test_invalid_lines(spark):
    def kept(flags):
        df = spark.createDataFrame([("p", i + 1, bool(b)) for i, b in enumerate(flags)], "path string, line_no int, is_bad boolean")
        return sorted(r["line_no"] for r in transcripts.cut_invalid(df).collect())

    assert kept([1, 0, 0]) == [1]
    assert kept([0, 0, 1, 0]) == [1, 2, 3, 4]  # a third is not too many
    assert kept([0, 1, 0]) == [1, 2]
    assert kept([0] * 100 + [1] * 30) == list(range(1, 126))


def test_merge_and_normalize(spark, roots):
    docs = {r["uid"]: r for r in normalize(parsed(spark, roots), T).collect()}
    p = docs["pi:p1"]
    assert p["body"] == "User: first\n\nUser: second\n\nAssistant: reply" and p["message_count"] == 3
    assert len(p["transcript_paths"]) == 2 and p["models"] == ["k1"] and p["title"] == "first"
    c = docs[f"claude:{U1}"]
    assert c["title_source"] == "native" and c["repo"] == "app" and c["resume_cmd"] == f"cd '/w/app' && claude --resume '{U1}'"
    assert docs["codex:c1"]["fork_cmd"] == "cd '/w/site' && codex fork 'c1'"


def test_sync(spark, roots, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    config = Config(embeddings=Embeddings("ollama", "hash", 16))
    embedder = HashingEmbedder(16, config.embeddings.model_key)
    first = run_sync(spark, store, roots, T, config, embedder)
    assert (first.discovered, first.changed, first.indexed, first.failed) == (5, 5, 4, 0)
    assert first.embedded_chunks == first.chunks > 0 and first.reused_embeddings == 0
    second = run_sync(spark, store, roots, T, config, embedder)
    assert (second.changed, second.deleted_sources, second.embedded_chunks, second.reused_embeddings) == (3, 0, second.chunks, second.chunks)
    corpus = Corpus.of(store.read("sessions"), store.read("session_docs"))
    assert [r["uid"] for r in search(corpus, "parsers", Context()).collect()] == [f"claude:{U1}"]
    # one file of a session goes: the session is merged again from the other; the whole session goes with its last file
    os.remove(os.path.join(roots["pi"][0], "a.jsonl"))
    os.remove(os.path.join(roots["codex"][0], "2026", "rollout-a.jsonl"))
    third = run_sync(spark, store, roots, T, config, embedder)
    assert third.deleted_sources == 2 and third.deleted_sessions == 1
    docs = {r["uid"]: r["body"] for r in store.read("session_docs").collect()}
    assert docs["pi:p1"] == "User: first" and "codex:c1" not in docs
    assert store.read("chunks").filter("uid = 'codex:c1'").count() == 0
    # a null record fails its file, which is tried again
    put(tmp_path / "pi" / "null.jsonl", {"type": "session", "id": "n"}, "null")
    fourth = run_sync(spark, store, roots, T, config, embedder)
    assert fourth.failed == 1 and store.read("parse_errors").count() == 1
    put(tmp_path / "pi" / "null.jsonl", {"type": "session", "id": "n"})
    assert run_sync(spark, store, roots, T, config, embedder).failed == 0 and store.read("parse_errors").count() == 0
    assert store.status().first()["vectors"] == store.read("chunks").count()
    store.clear("pi")
    assert {r["provider"] for r in store.read("sessions").collect()} == {"claude"}


def test_failing_embedder(spark, roots, tmp_path):
    class Broken(HashingEmbedder):
        def embed(self, texts, input_type="document"):
            raise RuntimeError("no model")

    store = Store(spark, str(tmp_path / "store"))
    out = run_sync(spark, store, roots, T, Config(), Broken(16, "broken"))
    assert out.embedding_failures == out.chunks and out.embedded_chunks == 0
    assert {r["embedding_error"] for r in store.read("chunks").collect()} == {"no model"}


def test_watch(spark, roots, tmp_path):
    got = []
    watch(spark, str(tmp_path / "store"), {"codex": roots["codex"]}, str(tmp_path / "cp"), lambda: T, on_sync=got.append)
    assert got and got[0].indexed == 1
    assert Store(spark, str(tmp_path / "store")).read("sessions").select(F.col("uid")).first()["uid"] == "codex:c1"


def test_project_dirs(spark):
    there = {"/w", "/w/my-app", "/w/my-app/.git-x"}
    assert transcripts.decode_with("-w-my-app--git-x-sub", there.__contains__) == "/w/my-app/.git-x/sub"
    assert transcripts.decode_with("-w-other", there.__contains__) == "/w/other" and transcripts.decode_with("", there.__contains__) is None
    df = spark.createDataFrame([("-w-my-app",), ("-w--x",), (None,)], "n string")
    got = df.select(transcripts.decode_project_dir(F.col("n")), transcripts.decoder(frozenset(there).__contains__)(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("/w/my/app", "/w/my-app"), ("/w/.x", "/w/x"), (None, None)]


def test_command_line(spark, roots, tmp_path, capsys):
    from threadloom.__main__ import run

    base = ["--store", str(tmp_path / "s"), *(x for p, rs in roots.items() for x in (f"--{p}-root", rs[0]))]
    assert run([*base, "sync", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] == 4
    run([*base, "search", "parser", "--json"], spark)
    found = json.loads(capsys.readouterr().out)
    assert [r["uid"] for r in found] == [f"claude:{U1}"] and "«parser»" in found[0]["snippet"]
    run([*base, "search", "parser", "provider:none"], spark)
    assert "unknown provider" in capsys.readouterr().err
    run([*base, "recent", "--limit", "5"], spark)
    assert "New name" in capsys.readouterr().out
    run([*base, "doctor"], spark)
    assert "sessions: 4" in capsys.readouterr().out
    run(["config"])
    assert json.loads(capsys.readouterr().out)["chunk_tokens"] == 512


def test_contents_open_only_what_is_asked(spark, tmp_path):
    """Files that aren't asked for may be unreadable: they aren't opened. Odd names are taken as they are."""
    root = tmp_path / "r"
    (root / "-w-x").mkdir(parents=True)
    names = ["a.jsonl", "b{1}[c]*.jsonl", "c.jsonl"]
    for n in names:
        (root / "-w-x" / n).write_text('{"type":"user"}\n')
    roots = {"claude": [str(root)], "codex": [], "pi": []}
    found = transcripts.discover(spark, roots)
    some = found.filter("path like '%b{1}%'")
    some = spark.createDataFrame(some.collect(), some.schema)  # without the listing's plan
    read = transcripts.contents(spark, roots, some)
    assert [r["path"].rpartition("/")[2] for r in read.collect()] == [names[1]]
    assert len(read.inputFiles()) == 1
    assert transcripts.contents(spark, roots, found.limit(0)).count() == 0


def test_tables_change_together(spark, tmp_path):
    store, reader = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    rows = lambda n: spark.createDataFrame([(f"u{i}", f"/p{i}") for i in range(n)], "uid string, path string")
    store.write("session_sources", rows(1))
    with store.together():
        store.write("session_sources", rows(2))
        store.write("index_meta", spark.createDataFrame([("a", "b")], "key string, value string"))
        assert store.read("session_sources").count() == 2 and reader.read("session_sources").count() == 1 and reader.version("index_meta") == 0
    assert reader.read("session_sources").count() == 2 and reader.read("index_meta").count() == 1
    with pytest.raises(RuntimeError), store.together():
        store.write("session_sources", rows(9))
        raise RuntimeError
    assert store.read("session_sources").count() == reader.read("session_sources").count() == 2
    store.write("session_sources", rows(3))
    assert reader.read("session_sources").count() == 3
