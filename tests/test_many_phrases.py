"""Many phrases over texts without lists: looked up in the texts, so that no word of a text is shuffled, with the same places as by lists."""

import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import lexical
from threadloom.queries import QUERIES

ROWS = [
    (0, "One two", "one two one two one two"), (1, None, "two one. One two x one two"), (2, "three", None), (3, "", ""), (4, "two", "ones and twos, one one one"),
    (5, "one", "one"), (6, None, None), (7, "x y z", "one two"), (8, "TWO", "y two z one"), (None, "one two", "one two"), *((i, "q", "q r s") for i in range(9, 30)),
]
ASKED = [["one two"], ["one", "two"], ["one one"], ["one two x one", "x"], ["one", "..."], ["none"], ["one", "none"], [], ["q r s", "q"], ["two one two"], ["one two"], ["s q r"]]


@pytest.mark.parametrize("name", ["many_query_search", "bm25_weighted_columns"])
def test_no_word_of_a_text_is_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "posexplode(tokens" in plan and not re.search(r"(SortMerge|ShuffledHash)Join \[[^\]]*\bterm#", plan)


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("stemmed", [False, True])
def test_same_places_as_by_lists(spark, monkeypatch, apart, stemmed):
    docs = spark.createDataFrame(ROWS, "doc long, title string, body string")
    index = lexical.build_index(docs, "doc", {"title": 0.5, "body": 1.5}, stemmed=stemmed)
    phrases = lexical.phrase_table(index, spark.createDataFrame(list(enumerate(ASKED)), "query int, phrases array<string>"), F.col("phrases"))
    hits = lambda: sorted(map(tuple, lexical.phrase_hits(index, phrases, apart).fillna(-1, ["doc"]).collect()))
    scores = lambda: {(r["query"], r["doc"]): round(r["bm25"], 12) for r in lexical.bm25(index, phrases, apart).collect()}
    mine = hits(), scores()
    monkeypatch.setattr(lexical, "PHRASE_WORDS", 0)  # more words than these meet in shuffles
    assert mine == (hits(), scores()) and {r[0] for r in mine[0]} >= {0, 1, 2, 3, 8, 10}
