from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.operators import ranking, vectors
from threadloom.operators.vectors import HashingEmbedder
from threadloom.plans.query import Filters, TextPlan
from threadloom.plans.search import Context, Corpus, recent, search, to_json

NOW = datetime(2026, 6, 20, 12, tzinfo=UTC)
LONG = " Lorem ipsum dolor sit amet." * 12


def sessions(spark):
    rows = [
        ("claude:1", "claude", "Fix login in auth.ts", "atlas", "main", "cli", "/w/atlas", "2026-06-19T00:00:00Z", False, 8, "please fix auth.ts", "User: please fix auth.ts login" + LONG),
        ("codex:2", "codex", "Other things", "site", None, "ide", "/w/site", "2026-06-01T00:00:00Z", False, 9, "login page", "User: login page broken" + LONG),
        ("pi:3", "pi", "Login agent", "atlas", None, "subagent", "/w/atlas", "2026-06-19T10:00:00Z", True, 9, "login", "User: login" + LONG),
        ("pi:4", "pi", "Cooking", None, None, "cli", "(unknown)", "not a time", False, 2, "soup", "User: soup and login"),
    ]
    names = "uid provider title repo branch surface cwd updated_at is_subagent message_count first_prompt body".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'boolean' if n == 'is_subagent' else 'int' if n == 'message_count' else 'string'}" for n in names))
    return df.withColumns(
        {
            "native_id": F.substring_index("uid", ":", -1),
            "created_at": F.col("updated_at"),
            "models": F.array(F.lit("m")),
            "resume_cmd": F.lit("r"),
            "fork_cmd": F.lit(None).cast("string"),
        }
    )


def corpus(spark, with_vectors=False):
    s = sessions(spark)
    docs = s.select("uid", "title", "first_prompt", "body")
    chunks = None
    if with_vectors:
        e = HashingEmbedder(32)
        rows = [(f"{r['uid']}#0", r["uid"], r["body"], e.embed([r["body"]])[0].tolist()) for r in docs.collect()]
        chunks = spark.createDataFrame(rows, "chunk_id string, uid string, text string, embedding array<float>")
    return Corpus.of(s.drop("body"), docs, chunks)


def test_keyword_search(spark):
    got = search(corpus(spark), "login auth.ts", Context(NOW)).collect()
    assert [r["uid"] for r in got] == ["claude:1"]
    assert "«login»" in got[0]["snippet"] and got[0]["snippet_source"] == "fts"
    both = search(corpus(spark), "login", Context(NOW, current_repo="atlas")).collect()
    assert [r["uid"] for r in both] == ["claude:1", "codex:2"]  # no subagent, no unreadable time
    assert both[0]["keyword_score"] == 1.0 and both[0]["position"] == 1


def test_filters(spark):
    c = corpus(spark)
    uids = lambda q, **k: [r["uid"] for r in search(c, q, Context(NOW), **k).collect()]
    assert uids("login include:subagents provider:pi") == ["pi:3"]
    assert uids("login repo:SITE") == ["codex:2"]
    assert uids("login since:3d") == ["claude:1"]
    assert uids("login since:3d", prefilter=True) == ["claude:1"]
    assert uids("login until:2026-06-10") == ["codex:2"]
    assert uids("nothing here") == []
    assert uids('"-"') == []


def test_browse_and_recent(spark):
    c = corpus(spark)
    got = search(c, "", Context(NOW)).collect()
    assert [r["uid"] for r in got] == ["claude:1", "codex:2"] and got[0]["snippet_source"] == "body"
    assert [r["uid"] for r in recent(c, 1, Context(NOW)).collect()] == []  # the one latest text is not a time
    assert [r["uid"] for r in recent(c, 2, Context(NOW)).collect()] == ["claude:1"]
    assert to_json(recent(c, 3, Context(NOW))).count() == 2


def test_hybrid(spark):
    c = corpus(spark, with_vectors=True)
    v = HashingEmbedder(32).embed(["User: login page broken"])[0].tolist()
    got = search(c, "login", Context(NOW), vector=v).collect()
    assert {r["uid"] for r in got} == {"claude:1", "codex:2"}
    assert all(r["vector_score"] is not None and r["keyword_score"] is not None for r in got)


def test_fusion_and_parts(spark):
    a = spark.createDataFrame([(0, "x", 1, 1.0), (0, "y", 2, 1.0)], "query int, uid string, keyword_rank int, keyword_score double")
    b = spark.createDataFrame([(0, "y", 1, 0.5), (0, "z", 2, 0.4)], "query int, uid string, vector_rank int, vector_score double")
    got = {r["uid"]: r["fusion_score"] for r in ranking.fuse(a, b).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61), "z": pytest.approx(1 / 62)}
    lists = a.select("query", "uid", F.col("keyword_rank").alias("rank")).unionByName(b.select("query", "uid", F.col("vector_rank").alias("rank")))
    assert {r["uid"]: r["fusion_score"] for r in ranking.rank_fusion(lists).collect()} == {k: pytest.approx(v) for k, v in got.items()}
    s = sessions(spark).withColumns({"keyword_rank": F.lit(1), "keyword_score": F.lit(1.0)})
    parts = ranking.score_parts(s.columns, TextPlan.of("auth.ts"), NOW, Filters(), "atlas", "/w")
    r = s.select("uid", *(v.alias(k) for k, v in parts.items())).filter("uid = 'claude:1'").first()
    assert r["title_boost"] == pytest.approx(0.2) and r["exactish_boost"] == pytest.approx(0.1)
    assert r["repo_boost"] == pytest.approx(0.1) and r["cwd_boost"] == pytest.approx(0.05) and r["short_penalty"] == 0
    assert r["recency_boost"] == pytest.approx(0.08 * 0.5 ** (1.5 / 30))


def test_vectors(spark):
    rows = [(i, [float(i), 0.0]) for i in range(5)] + [(9, [1.0]), (10, None)]
    t = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.2, 0.0])], "query int, vector array<float>")
    got = vectors.nearest(t, q, 3).orderBy("vector_rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 0] and got[0]["distance"] == pytest.approx(0.2, rel=1e-5)
    with pytest.raises(ValueError):
        vectors.checked([[1.0, 2.0]], 1, 3)
    assert [r[0] for r in t.orderBy("chunk_id").select(vectors.valid_vector(F.col("embedding"), 2)).collect()][:1] == [True]
