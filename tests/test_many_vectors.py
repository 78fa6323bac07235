import duckdb
import pytest

from threadloom import queries
from threadloom.operators import vectors

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["knn_l2_topk_many", "knn_session_best_many"])
def test_every_stated_query(spark, name, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 150)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES[name]).fetchall())
    got = queries.QUERIES[name](spark, DATA)
    assert got.columns == [c[0] for c in con.execute(queries.ORACLES[name]).description]
    got = sorted(map(tuple, got.collect()))
    assert len({r[0] for r in got}) == 25 and len(got) == len(want)
    assert all(a == pytest.approx(b, abs=2e-5) for a, b in zip(got, want, strict=True))


def test_widths_ties_and_nulls(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [3.0, 0.0])]
    t = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(10, [0.0, 0.0]), (11, [1.0, 2.0, 3.0]), (12, None), (13, [0.0])], "query int, vector array<float>")
    for k in (1, 2, 9):
        want, got = (sorted(map(tuple, f(t, q, k).collect())) for f in (vectors.nearest, vectors.nearest_of_many))
        assert got == want and want
