"""Scores that are equal by their parts, and queries held against their SQL where texts repeat."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from threadloom import queries as engine
from threadloom.operators import lexical
from threadloom.operators.ranking import Weights
from threadloom.plans.search import Context, search

from . import test_search


def test_parts_are_added_in_one_order(spark):
    """Texts whose words stand equally often, whichever word that is, tie; ties go by document."""
    texts = [" ".join(" ".join([w] * n) for w, n in zip("abcd", counts, strict=True)) for counts in permutations((1, 2, 3, 7))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = lexical.build_index(docs, "doc_id", {"text": 1.0}, stemmed=False)
    asked = spark.createDataFrame([(0, list("abcd"))], "query int, phrases array<string>")
    found = lexical.top_keyword_hits(lexical.bm25(index, lexical.phrase_table(index, asked, F.col("phrases")))).orderBy("keyword_rank").collect()
    assert len({r["bm25"] for r in found}) == 1
    assert [r["doc"] for r in found] == list(range(len(texts)))


def _held(spark, tmp_path, name, **tables):
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = engine.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({engine.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got.collect()) == plain(want)
    return want


def test_phrase_that_follows_itself(spark, tmp_path):
    texts = ["one two one two", "one two x one two", "one two one two one two", "y one two", "one one one one", *["z"] * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two"), (2, "one"), (3, "one one"), (4, ""), (5, "two one two")], "item_id long, text string")
    want = _held(spark, tmp_path, "many_query_search", documents=docs, benchmark=items)
    assert {r[0] for r in want} == {1, 2, 3, 5}


def test_order_by_rounded_scores(spark):
    """Scores that are equal to the stated digits go by title, then time."""
    uids = lambda w: [r["uid"] for r in search(test_search.corpus(spark), "login include:subagents", Context(test_search.NOW, weights=w)).collect()]
    assert uids(Weights()) == ["claude:1", "pi:3", "codex:2"]
    assert uids(Weights(score_digits=0)) == ["pi:3", "claude:1", "codex:2"]
