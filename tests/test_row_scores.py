"""Scores that are made in a document's own row: the same as those by lists, with no document shuffled to be counted."""

import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import lexical
from threadloom.queries import QUERIES


@pytest.mark.parametrize("name", ["hybrid_search", "rrf_fusion", "bm25_topk", "bm25_and_phrases"])
def test_no_document_is_shuffled_by_its_number(spark, name):
    """Small rows of all documents made one task of a shuffle, whose memory grew with the table."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\bdoc#", plan)


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("stemmed", [False, True])
def test_same_scores_as_by_lists(spark, apart, stemmed):
    rows = [
        (0, "One two", "one two one two one two"), (1, None, "two one. One two x one two"), (2, "three", None), (3, "", ""), (4, "two", "ones and twos, one one one"),
        (5, "one", "one"), (6, None, None), (7, "x y z", "one two"), (8, "TWO", "y two z one"), (None, "one two", "one two"), *((i, "q", "q r s") for i in range(9, 30)),
    ]
    docs = spark.createDataFrame(rows, "doc long, title string, body string")
    index = lexical.build_index(docs, "doc", {"title": 0.0, "body": 1.5}, stemmed=stemmed)
    asked = [["one two"], ["one", "two"], ["one one"], ["one two x one", "x"], ["one", "..."], ["none"], ["one", "none"], [], ["q r s", "q"], ["two"]]
    phrases = lexical.phrase_table(index, spark.createDataFrame(list(enumerate(asked)), "query int, phrases array<string>"), F.col("phrases"))
    terms = [r["term"] for r in phrases.select("term").distinct().collect() if r["term"]]
    found = lambda scored: {(r["query"], r["doc"]): round(r["bm25"], 12) for r in scored.collect()}
    want = found(lexical.bm25(index, phrases, apart))
    assert {q for q, _ in want} == {0, 1, 2, 3, 8, 9}
    assert found(lexical.bm25_of_rows(index.only(terms), phrases, apart)) == want


def test_rows_of_a_frequent_word_spread(spark):
    """Few words go to the rows of the texts, and what a document has of them goes by its number to a stated number of tasks."""
    docs = spark.createDataFrame([(1, "the sea"), (2, "the the")], "doc long, body string")
    index = lexical.build_index(docs, "doc", {"body": 1.0}, stemmed=False).only(["the"])
    phrases = lexical.phrase_table(index, spark.createDataFrame([(0, ["the"])], "query int, phrases array<string>"), F.col("phrases"))
    counts = index.counts(phrases.select("term"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term#" not in plan and re.search(r"hashpartitioning\(doc#\d+L, 4\), REPARTITION_BY_NUM", plan)
    assert sorted((r["doc"], r["n"]) for r in counts.collect()) == [(1, 1), (2, 2)]
    assert "REPARTITION_BY_NUM" in lexical.bm25(index, phrases)._jdf.queryExecution().executedPlan().toString()
