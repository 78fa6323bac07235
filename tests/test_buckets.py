"""Tables in buckets: what a change touches, what stays, and one writer at a time."""

import glob
import json
import os
import threading
import time

import pytest

from threadloom.operators import store as tables
from threadloom.operators.store import Busy, Store
from threadloom.plans.sync import run_sync
from threadloom.schemas import TABLES
from threadloom.streaming.watch import watch

T = "2026-06-20T12:00:00Z"


def links(spark, rows):
    return spark.createDataFrame(rows, TABLES["session_sources"])


def files(store, table):
    return {f.partition(f"/{table}/")[2] for f in store.read(table).inputFiles()}


def rows(store, table="session_sources"):
    return sorted(tuple(r) for r in store.read(table).collect())


def put(path, uid, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    meta = {"type": "session_meta", "timestamp": T, "payload": {"id": uid, "cwd": "/w/site"}}
    said = {"type": "response_item", "timestamp": T, "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}}
    path.write_text(json.dumps(meta) + "\n" + json.dumps(said) + "\n")


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.write("session_sources", links(spark, [(f"u{i}", f"/p{i}") for i in range(100)] + [(None, "/none")]))
    before = files(store, "session_sources")
    assert len(before) == 8 and len(store.read("session_sources").collect()) == 101
    store.change("session_sources", ["uid"], new=links(spark, [("u7", "/new"), ("u7", "/newer")]))
    after = files(store, "session_sources")
    assert len(before & after) == 7 and len(after - before) == 1
    got = {(r["uid"], r["path"]) for r in store.read("session_sources").collect()}
    assert got == {(f"u{i}", f"/p{i}") for i in range(100) if i != 7} | {("u7", "/new"), ("u7", "/newer"), (None, "/none")}
    # nothing to change: nothing is written, and no version is made
    n = store.version("session_sources")
    store.change("session_sources", ["uid"], new=links(spark, []), gone=links(spark, []))
    assert store.version("session_sources") == n and files(store, "session_sources") == after
    # a change needs the column that buckets go by
    with pytest.raises(ValueError):
        store.change("session_sources", ["path"], gone=links(spark, [("u1", "/p1")]))


def test_changes_are_those_of_whole_tables(spark, tmp_path):
    """A run of random changes, held against the same changes of a plain table."""
    import random

    draw, plain = random.Random(4), {}
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    for turn in range(6):
        new = [(f"/p{draw.randrange(30)}", f"{turn}") for _ in range(draw.randrange(4))]
        new = list(dict(new).items())
        gone = [f"/p{draw.randrange(30)}" for _ in range(draw.randrange(6))]
        frame = spark.createDataFrame([(p, "pi", 1, 1.0, v, v, v, None) for p, v in new], TABLES["sources"])
        store.change("sources", ["path"], new=frame, gone=spark.createDataFrame([(g,) for g in gone], "path string"), keep=("first_seen_at",))
        plain = {p: v for p, v in plain.items() if p not in gone}
        plain |= {p: (plain[p][0] if p in plain else v, v) for p, v in new}
        assert {r["path"]: (r["first_seen_at"], r["last_seen_at"]) for r in store.read("sources").collect()} == plain
        store.vacuum()
    # emptied, and filled again
    store.change("sources", ["path"], gone=store.read("sources"))
    assert store.read("sources").count() == 0
    store.change("sources", ["path"], new=spark.createDataFrame([("/x", "pi", 1, 1.0, "", "", "", None)], TABLES["sources"]))
    store.vacuum()
    assert [r["path"] for r in store.read("sources").collect()] == ["/x"]


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    store, reader = Store(spark, str(tmp_path / "s"), buckets=4), Store(spark, str(tmp_path / "s"))
    store.write("session_sources", links(spark, [(f"u{i}", "/p") for i in range(40)]))
    for i in range(5):
        before = reader.read("session_sources")  # planned before the change, read after it
        store.change("session_sources", ["uid"], new=links(spark, [("u1", f"/{i}")]))
        store.vacuum()
        assert before.count() == 40
    assert len(rows(store)) == 40 and ("u1", "/4") in rows(store)
    # of the bucket that always changes two versions lie there, of the others one
    held = glob.glob(f"{tmp_path}/s/session_sources/v*/bucket=*")
    assert len(held) == 5, held


def test_a_store_without_buckets_is_taken_over(spark, tmp_path):
    links(spark, [("u1", "/a"), ("u2", "/b")]).write.parquet(f"{tmp_path}/s/session_sources/v3")
    (tmp_path / "s" / "_CATALOGUE").write_text('{"session_sources": 3}')
    store = Store(spark, str(tmp_path / "s"))
    assert store.version("session_sources") == 3 and rows(store) == [("u1", "/a"), ("u2", "/b")]
    store.vacuum()
    store.change("session_sources", ["uid"], gone=links(spark, [("u1", "")]))
    assert rows(store) == [("u2", "/b")] and store.version("session_sources") == 4


def test_a_sync_rewrites_what_changed(spark, tmp_path):
    root = tmp_path / "codex"
    for i in range(24):
        put(root / f"rollout-{i}.jsonl", f"c{i}", f"text {i}")
    store, roots = Store(spark, str(tmp_path / "s"), buckets=8), {"codex": [str(root)]}
    run_sync(spark, store, roots, T)
    kept = ("sessions", "session_docs", "session_sources", "chunks", "sources")
    before = {t: files(store, t) for t in kept}
    run_sync(spark, store, roots, T)
    assert {t: files(store, t) for t in kept} == before
    put(root / "rollout-3.jsonl", "c3", "another text")
    assert run_sync(spark, store, roots, T).changed == 1
    for t in kept:
        assert len(files(store, t) - before[t]) == 1 and len(before[t] - files(store, t)) == 1, t
    assert store.read("session_docs").filter("uid = 'codex:c3'").first()["body"] == "User: another text"
    assert store.read("sessions").count() == store.read("session_docs").count() == 24


def test_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    assert not os.path.exists(tmp_path / "s")
    with store.writing():
        assert oct(os.stat(tmp_path / "s").st_mode & 0o777) == "0o700"
        assert os.path.exists(tmp_path / "s" / "_LOCK")
    assert not os.path.exists(tmp_path / "s" / "_LOCK")
    (tmp_path / "s" / "_LOCK").write_text("another process")
    with pytest.raises(Busy):
        run_sync(spark, store, {}, T)
    assert (tmp_path / "s" / "_LOCK").read_text() == "another process"
    monkeypatch.setattr(tables, "STALE_SECONDS", -1)  # its writer has died
    with store.writing():
        assert (tmp_path / "s" / "_LOCK").read_text() != "another process"


def test_two_syncs_of_one_process_wait_for_each_other(spark, tmp_path):
    for p in "ab":
        put(tmp_path / p / f"rollout-{p}.jsonl", p, p)
    failed = []

    def go(p):
        try:
            run_sync(spark, Store(spark, str(tmp_path / "s")), {"codex": [str(tmp_path / "a"), str(tmp_path / "b")]} if p == "b" else {"codex": [str(tmp_path / "a")]}, T)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    both = [threading.Thread(target=go, args=(p,)) for p in "ab"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert not failed
    assert "codex:a" in {r["uid"] for r in Store(spark, str(tmp_path / "s")).read("sessions").collect()}


def test_watch_goes_on_over_two_roots(spark, tmp_path):
    """One query for both roots; files that come later are taken in, and none is lost to another batch."""
    a, b = tmp_path / "a", tmp_path / "b"
    put(a / "rollout-1.jsonl", "a1", "one")
    put(b / "rollout-1.jsonl", "b1", "one")
    store, seen = Store(spark, str(tmp_path / "s")), []
    query = watch(spark, store.root, {"codex": [str(a), str(b)]}, str(tmp_path / "cp"), lambda: T, on_sync=seen.append, once=False)
    try:
        def wait(n):
            end = time.time() + 90
            while time.time() < end and (not seen or store.read("sessions").count() < n):
                assert query.exception() is None
                time.sleep(0.5)
            return {r["uid"] for r in store.read("sessions").collect()}

        assert wait(2) == {"codex:a1", "codex:b1"}
        put(a / "rollout-2.jsonl", "a2", "two")
        put(b / "rollout-2.jsonl", "b2", "two")
        assert wait(4) == {"codex:a1", "codex:b1", "codex:a2", "codex:b2"}
    finally:
        query.stop()
    assert watch(spark, store.root, {}, str(tmp_path / "none"), lambda: T) is None
