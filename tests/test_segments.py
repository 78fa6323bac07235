"""An index that follows its documents, against one that is made at once."""

import random

from pyspark.sql import functions as F

from threadloom.operators import lexical
from threadloom.operators.segments import SegmentedIndex

FIELDS = {"title": 5.0, "body": 1.0}
WORDS = "the of a cat dog runs house é x1 of".split()
KIND = "uid string, title string, body string"


def made(r, n):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))


def scores(spark, index):
    asked = spark.createDataFrame([(0, ["of the", "cat"]), (1, ["dog"]), (2, ["the the"]), (3, ["x1", "house"]), (4, ["a cat runs"]), (5, ["none"])], "query int, phrases array<string>")
    found = lexical.bm25(index, lexical.phrase_table(index, asked, F.col("phrases"))).collect()
    return {(x["query"], x["doc"]): round(x["bm25"], 9) for x in found}


def files(path):
    return {str(p.relative_to(path)) for p in path.glob("segment=*/*.parquet")}


def test_follows_changes(spark, tmp_path):
    """After each of some refreshes with new, changed, lost and returning documents, scores are those of a fresh index."""
    r = random.Random(2)
    index = SegmentedIndex(spark, str(tmp_path / "index"), FIELDS, stemmed=False, factor=3)
    docs = {}
    assert scores(spark, index.index()) == {}
    merged = 0
    for step in range(7):
        old = dict(docs)
        for k in range(40) if step == 0 else r.sample(range(60), 6):
            docs[f"d{k}"] = (made(r, 4), r.choice([made(r, 30), None, ""]))
        for k in r.sample(sorted(docs), 4) if step else []:
            docs.pop(k)
        if step == 5:
            docs = {k: docs[k] for k in sorted(docs)[:4]}  # most of the largest segment dies
        df = spark.createDataFrame([(k, *v) for k, v in docs.items()], KIND)
        told = index.refresh(df, "uid", step)
        assert told["added"] == sum(old.get(k) != v for k, v in docs.items())
        assert told["removed"] == sum(docs.get(k) != v for k, v in old.items())
        merged += told["merged"]
        state = index.state()
        assert state["of"] == step and sum(s["docs"] for s in state["segments"].values()) == len(docs)
        assert all(2 * s["docs"] >= s["written"] for s in state["segments"].values())
        assert scores(spark, index.index()) == scores(spark, lexical.build_index(df, "uid", FIELDS, stemmed=False))
    assert merged >= 4


def test_one_change_makes_one_document(spark, tmp_path):
    """One of many documents changes: one is made into words, no list of another segment is written again, and nothing happens without a change."""
    rows = [(f"d{k}", "t", f"cat dog {k}") for k in range(50)]
    index = SegmentedIndex(spark, str(tmp_path), FIELDS, stemmed=False)
    assert index.refresh(spark.createDataFrame(rows, KIND), "uid") == {"added": 50, "removed": 0, "merged": 0}
    before = files(tmp_path)
    rows[7] = ("d7", "t", "cat house")
    assert index.refresh(spark.createDataFrame(rows, KIND), "uid") == {"added": 1, "removed": 1, "merged": 0}
    assert before < files(tmp_path)
    new = spark.read.parquet(str(tmp_path / "segment=2"))
    assert {r["doc"] for r in new.collect()} == {"d7"} and {r["term"] for r in new.collect()} == {"t", "cat", "house"}
    state = index.state()
    assert index.refresh(spark.createDataFrame(rows, KIND), "uid") == {"added": 0, "removed": 0, "merged": 0}
    assert index.state()["live"] == state["live"]
    assert index.refresh(spark.createDataFrame([], KIND), "uid")["removed"] == 50
    assert scores(spark, index.index()) == {}


def test_phrases_read_no_text(spark, tmp_path):
    """Phrases come from lists alone; terms reach the scan."""
    df = spark.createDataFrame([("a", "t", "of the cat of the"), ("b", None, "the of")], KIND)
    index = SegmentedIndex(spark, str(tmp_path), FIELDS, stemmed=False)
    index.refresh(df, "uid")
    asked = spark.createDataFrame([(0, ["of the"])], "query int, phrases array<string>")
    one = index.index().only(["of", "the"])
    hits = lexical.phrase_hits(one, lexical.phrase_table(one, asked, F.col("phrases")))
    assert [(r["doc"], r["hits"]) for r in hits.collect()] == [("a", 2)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan and "In(term, [of,the])" in plan
