import hashlib

from pyspark.sql import functions as F

from threadloom.functions import textops as T
from threadloom.operators import chunks


def one(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_clean(spark):
    dirty = "\x1b[31mred\x1b[0m <environment_context>x\ny</environment_context> a<b>c\r\nq\nq\nq\nq\nq\n\n\n\nend  "
    assert one(spark, T.clean_text, dirty) == ["red   a c\nq\nq\nq\n\nend"]
    assert one(spark, lambda c: T.clean_text(c, F.lit("codex")), "# In app browser: x\n## My request for Codex: do it") == ["do it"]


def test_noise(spark):
    texts = ["hello", "", "Chunk ID: 3", "{" + "x" * 250 + "}", "## Skills", "current_date and workspace_roots", "ABC=1\n" + "y" * 1000]
    assert one(spark, T.is_noise, *texts) == [False] + [True] * 6


def test_titles(spark):
    got = one(spark, T.synthesize_title, "Hey, please fix `foo` now. And more", None, "...", "x" * 90, "Can you do it?", ". a")
    assert got == ["fix foo now.", "(untitled)", "...", "x" * 77 + "...", "do it?", ". a"]


def test_redaction(spark):
    text = "Authorization: Bearer abcdef MY_API_KEY=0123456789abcdefXYZ password: 'hunter2hunter2' ghp_" + "a" * 24
    df = T.with_redaction(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert df["redactions"] >= 4
    for mark in ("<REDACTED_BEARER_TOKEN>", "API_KEY=<REDACTED_API_KEY>", "password=<REDACTED_SECRET>", "<REDACTED_GITHUB_TOKEN>"):
        assert mark in df["redacted"]
    assert one(spark, T.redacted, text) == [df["redacted"]]


def test_estimates_and_commands(spark):
    assert one(spark, T.token_estimate, "", "a b!", "x" * 10, "  ") == [0, 3, 3, 0]
    assert [chunks.estimate(t) for t in ("", "a b!", "x" * 10)] == [0, 3, 3]
    assert one(spark, T.shell_quote, "it's") == ["'it'\\''s'"]
    made = one(spark, lambda c: T.resume_command(F.lit("codex"), F.lit("id"), c), "/a b")
    assert made == ["cd '/a b' && codex resume 'id'"]
    assert one(spark, lambda c: T.fork_command(F.lit("claude"), F.lit("id"), c), "/a") == [None]
    assert one(spark, lambda c: T.embedding_text(c, "query", "embeddinggemma"), "x") == ["task: search result | query: x"]


def test_chunks(spark):
    docs = spark.createDataFrame(
        [
            ("a", " ".join(f"word{i}" for i in range(80))),
            ("b", " ".join(f"token{i}" for i in range(400))),
            ("c", "a b " + "z" * 3000 + " c d"),
            ("d", "  "),
            ("e", None),
        ],
        "uid string, body string",
    )
    a = chunks.chunk_documents(docs.filter("uid = 'a'"), target=20, overlap=5, most=10).orderBy("ord").collect()
    assert len(a) > 1 and a[1]["start_char"] < a[0]["end_char"] and [x["ord"] for x in a] == list(range(len(a)))
    assert all(x["text_sha256"] == hashlib.sha256(x["text"].encode()).hexdigest() for x in a)
    b = chunks.chunk_documents(docs.filter("uid = 'b'"), target=10, overlap=0, most=5).orderBy("ord").collect()
    assert len(b) == 5 and b[0]["text"].startswith("token0 ") and b[-1]["text"].endswith("token399")
    starts = [w[0] for w in chunks.windows("a b " + "z" * 3000 + " c d")]
    assert starts == sorted(set(starts))
    assert chunks.chunk_documents(docs.filter("uid in ('d', 'e')")).count() == 0
