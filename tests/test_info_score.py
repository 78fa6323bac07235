"""Information scores: the same as by the plain rules, in time that grows with the text."""

import re
import time

from pyspark.sql import functions as F

from threadloom.operators import chunks


def by_rules(text: str) -> float:
    terms = re.findall(r"[A-Za-z_][A-Za-z0-9_./:-]{2,}", text)
    code = sum(bool(re.search(r"[._/:=-]|[A-Z][a-z]+[A-Z]|[a-z]+[A-Z]", t)) for t in terms)
    roles = len(re.findall(r"(?<![A-Za-z0-9_])(?:User|Assistant):", text))
    paths = len(re.findall(r"(?<![^\s\u00a0])[A-Za-z0-9_./-]+\.(?:ts|tsx|js|jsx|json|md|sql|py|go|rs|css|html)\b", text, re.ASCII))
    return len({t.lower() for t in terms}) / max(1, len(text)) + code * 0.05 + roles * 0.1 + paths * 0.2


def test_scores_follow_the_rules(spark):
    texts = [
        "", "no marks at all", "User: see src/a.ts and b.tsx, c.json.\nAssistant: xUser: User:User:", "a.py\u00a0b.go\tc.rs\nd.css e.html f.sqlx g.md! (h.py) .js x.jsx",
        "camelCase CamelCase ABcD aB Ab AAb snake_case a:b x/y.z", "\u00e9a.py a\u00e9.py \u00e9 a.py\u00e9", "a.b.ts.tsx.md/x.py- 1.ts _.js -.py",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = dict(map(tuple, df.select("id", F.round(chunks.info_score(F.col("text"), F.length("text")), 6)).collect()))
    assert found == {i: round(by_rules(t), 6) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "text string").select(chunks.info_score(F.col("text"), F.length("text"))).first()[0] is None


def test_long_runs_of_small_letters(spark):
    """The search for a capital behind small letters went through a run again from each of its letters."""
    text = "a" * 400_000
    began = time.monotonic()
    score = spark.createDataFrame([(text,)], "text string").select(chunks.info_score(F.col("text"), F.length("text"))).first()[0]
    assert score == 1 / len(text)
    assert time.monotonic() - began < 15
