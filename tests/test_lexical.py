import random
import sqlite3

import pytest

from threadloom.functions.porter import stem
from threadloom.operators import lexical
from threadloom.operators.snippets import match_excerpt
from threadloom.plans.query import match_expression, search_tokens
from pyspark.sql import functions as F

WORDS = "run running runs cat cats Äpfel naïve API_KEY relational hopeful the of a caresses ponies x1 foo-bar".split()


def fts(rows):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, first_prompt, body, tokenize='porter unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, title, first_prompt, body) VALUES (?, ?, ?, ?)", rows)
    return db


def test_stems_match_sqlite():
    words = "ies eed feed agreed plastered motoring conflated hopping falling filing sky relational digitizer radicalli vietnamization \
        triplicate electrical goodness revival allowance adoption probate rate cease controll roll y by oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    assert {words[doc]: term for term, doc in db.execute("SELECT term, doc FROM v")} == {w: stem(w) for w in words}


@pytest.mark.parametrize("seed", [1, 2])
def test_bm25_matches_sqlite(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    rows = [(i, text(4), text(6), text(30)) for i in range(40)]
    db = fts(rows)
    queries = ["run", "cats naive", '"running cat"', "api_key", "-", "the of", '"the the" a', "missing"]
    docs = spark.createDataFrame(rows, "uid long, title string, first_prompt string, body string")
    index = lexical.build_index(docs, "uid", lexical.SESSION_WEIGHTS)
    asked = spark.createDataFrame([(q, search_tokens(q)) for q in queries], "query string, phrases array<string>")
    got = lexical.bm25(index, lexical.phrase_table(index, asked, F.col("phrases"))).collect()
    for q in queries:
        want = dict(db.execute("SELECT rowid, bm25(t, 5.0, 2.5, 1.0) FROM t WHERE t MATCH ?", (match_expression(q),)))
        mine = {x["doc"]: x["bm25"] for x in got if x["query"] == q}
        assert mine.keys() == want.keys()
        assert all(mine[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the running cats"), (2, "a cat runs"), (3, None)], "uid long, body string")
    made = lexical.build_index(docs, "uid", {"body": 1.0})
    kept = made.saved(str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, ["run cats"]), (1, ["cat"])], "query int, phrases array<string>")
    score = lambda i: sorted(map(tuple, lexical.bm25(i, lexical.phrase_table(i, asked, F.col("phrases"))).collect()))
    assert score(made) == score(kept) == score(kept.only(["run", "cat"])) and len(score(made)) == 3
    scan = kept.only(["cat"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in scan or "EqualTo(term,cat)" in scan


def test_excerpt_marks():
    assert match_excerpt("The cats run home", [["cat"], ["run", "home"]]) == "The «cats» «run home»"
    long = " ".join(f"w{i}" for i in range(100)) + " target end"
    cut = match_excerpt(long, [["target"]])
    assert "«target»" in cut and cut.startswith("…") and len(cut.split()) <= 18
