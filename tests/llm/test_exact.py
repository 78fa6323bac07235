import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from threadloom.llm import exact
from threadloom.llm.common import shared_path

from .common import docs, plain

ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "é"), (7, "é"), (8, "x" * 200_000), (9, "x" * 200_000), (10, "a "), (2, "a"), (None, "a"), (None, "n"), (None, "n")]


def slow(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def key(x):
    return tuple(map(str, x))


def test_groups(spark):
    got = exact.exact_groups(docs(spark, plain(ROWS))).drop("locator").collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, slow(ROWS)))
    assert exact.exact_groups(docs(spark, [])).collect() == []


def test_drop(spark):
    kept = exact.drop_copies(docs(spark, plain(ROWS)))
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t in ROWS})
    assert {r["doc_id"] for r in kept.filter("text = 'a'").collect()} == {2} and kept.columns == docs(spark, []).columns


def test_equal_digests_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(exact, "_digest", lambda c: F.unhex(F.lpad(F.hex(F.length(F.coalesce(F.col(c), F.lit("")))), 64, "0")))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "xyz"), (6, None)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs(spark, plain(rows))).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def test_stream_goes_on(spark):
    digests, checkpoint, out = (shared_path(spark, n) for n in ("d", "c", "o"))
    sha = F.unhex(F.sha2("t", 256)).alias("digest")
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, t string").select("doc_id", sha, F.length("t").cast("long").alias("n_bytes"), F.lit("f").alias("locator")).write.mode("append").parquet(digests)
    put([(1, "a"), (2, "b")])
    exact.stream_state(digests, spark, checkpoint, out)
    put([(5, "a"), (3, "c")])
    exact.stream_state(digests, spark, checkpoint, out)
    last = spark.read.parquet(out).groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size"), "batch").alias("s")).select("s.*").collect()
    assert sorted(map(tuple, last)) == [(2, 1), (3, 1), (5, 2)]


def test_main_path_is_native(spark):
    plan = exact.exact_groups(docs(spark, plain(ROWS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def by_row(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in df.collect())


def told(rows, every=None):
    groups = defaultdict(list)
    for i, t in every or rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(keep[t or ""]), len(groups[t or ""]), i == keep[t or ""]) for i, t in rows)


def test_ingests_add_up(spark):
    state = shared_path(spark, "state")
    first, second, third = [(1, "a"), (2, "b"), (3, "b"), (4, None)], [(9, "a"), (5, "c"), (None, "b"), (6, "")], [(7, "c"), (8, "d")]
    assert by_row(exact.ingest(docs(spark, plain(first)), state, "one")) == told(first)
    assert by_row(exact.ingest(docs(spark, plain(second)), state, "two")) == told(second, first + second)
    assert by_row(exact.ingest(docs(spark, plain(second)), state, "two")) == told(second, first + second)  # again after a failure: nothing counts twice
    assert by_row(exact.ingest(docs(spark, []), state, "none")) == []
    got = exact.ingest(docs(spark, plain(third)), state, "three")
    assert by_row(got) == told(third, first + second + third)
    located = {r["doc_id"]: r["locator"] for r in got.collect()}
    assert "/content/two/" in located[7] and located[8] is None  # the text came first in the second ingest
    assert by_row(exact.ingested(spark, state)) == told(first + second + third)


def test_digest_clash_across_ingests(spark, monkeypatch):
    monkeypatch.setattr(exact, "_digest", lambda c: F.unhex(F.lpad(F.hex(F.length(F.coalesce(F.col(c), F.lit("")))), 64, "0")))
    state = shared_path(spark, "state")
    parts = [[(1, "ab"), (2, "xyz")], [(3, "cd")], [(4, "ab"), (5, "xyz"), (6, "ef")]]
    seen = []
    for n, part in enumerate(parts):
        seen += part
        assert by_row(exact.ingest(docs(spark, plain(part)), state, f"p{n}")) == told(part, seen)
    assert by_row(exact.ingested(spark, state)) == told(seen)
