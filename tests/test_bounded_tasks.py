"""What tasks hold and shuffle at once, with the same results."""

import random
import tracemalloc

from pyspark.sql import functions as F

from threadloom.operators import chunks, lexical, vectors


def test_windows_hold_numbers_only():
    text = "alpha-beta gamma " * 100_000
    tracemalloc.start()
    found = list(chunks.windows(text, 10**9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, len(text), 300_000)] or len(found) == 1
    assert peak < 60 * 200_000  # bytes a word; the words themselves would take more


def test_lists_are_made_without_a_shuffle(spark):
    r = random.Random(3)
    rows = [(i, *(" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 60))) if r.random() > 0.1 else None for _ in range(2))) for i in range(50)]
    docs = spark.createDataFrame(rows, "uid long, title string, body string")
    texts = lexical.build_index(docs, "uid", {"title": 2.0, "body": 1.0}, stemmed=False).texts
    made = lexical._lists_of_texts(texts)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.select("doc", "field", "term", "n", F.col("positions").cast("string")).collect()))
    assert key(made) == key(lexical._lists(lexical._postings(texts))) != []


def test_neighbours_over_several_slices(spark):
    """Vectors of more slices than one, many of them equal; ties go by id."""
    n = vectors.SLICE_VECTORS * 2 + 100
    table = spark.range(n).select(F.col("id").alias("chunk_id"), F.array((F.col("id") % 97).cast("float"), (F.col("id") % 3).cast("float")).alias("embedding"))
    asked = table.filter("chunk_id % 1000 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("vector"))
    key = lambda df: sorted(map(tuple, df.select("query", "chunk_id", "distance", "vector_rank").collect()))
    assert key(vectors.nearest_of_many(table, asked, 50)) == key(vectors.nearest(table, asked, 50))
