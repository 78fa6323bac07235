"""How often a sync opens files and goes over their texts."""

from threadloom.operators.store import Store
from threadloom.operators.vectors import HashingEmbedder
from threadloom.plans.sync import run_sync
from threadloom.sources import transcripts

from tests.test_sync import T, put


def test_a_file_is_opened_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        said = {"type": "user", "timestamp": "2026-06-01T00:00:01Z", "sessionId": "s", "message": {"role": "user", "content": f"<b>hello</b> {i}"}}
        put(tmp_path / "claude" / "-w-x" / f"{i}.jsonl", said)
    put(tmp_path / "claude" / "-w-x" / "bad.jsonl", {"type": "user", "sessionId": "t"}, None)
    plans, stage = [], Store.stage

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(self, df)

    monkeypatch.setattr(Store, "stage", noted)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    made = run_sync(spark, store, {"claude": [str(tmp_path / "claude")]}, T, embedder=HashingEmbedder(4))
    assert (made.discovered, made.indexed, made.failed, made.embedded_chunks) == (4, 1, 1, 1)
    assert store.read("session_docs").first()["body"] == "User: hello  0\n\nUser: hello  1\n\nUser: hello  2"
    assert {r["path"].rpartition("/")[2] for r in store.read("sources").collect()} == {"0.jsonl", "1.jsonl", "2.jsonl"}
    assert store.read("parse_errors").count() == 1
    assert sum("content:binary" in p for p in plans) == 1


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        put(tmp_path / "-w-x" / f"{i:03}.jsonl", {"type": "user"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # the reader gives each file a task
    try:
        roots = {"claude": [str(tmp_path)], "codex": [], "pi": []}
        found = transcripts.discover(spark, roots)
        assert found.count() == transcripts.contents(spark, roots, found).count() == 200
        plan = transcripts.contents(spark, roots, found)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Coalesce ") == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
