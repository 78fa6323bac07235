import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from threadloom.llm import langid

from .common import docs

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in langid.identify(spark.read.parquet(SF)).collect()}
    rows = pq.read_table(SF).to_pylist()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(x["held_out"] for x in got.values()) == len(held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_hard_cases(spark):
    rows = [(i, "the cat and the dog were there with all of them", "en") for i in range(60)]
    rows += [(100 + i, "der Hund und die Katze sind nicht mehr so jung", "de") for i in range(60)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", None), (503, "the dog " * 20000, None), (None, "die Katze und der Hund", None), (504, "é", None)]
    got = langid.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[None]["held_out"]
    assert by[504]["lang_pred"] in ("en", "de")
    kept = langid.keep_identified(docs(spark, rows))
    assert {500, 501, 502}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.columns == docs(spark, rows).columns


@pytest.mark.parametrize("rows", [[], [(1, "words", None)], [(1, "words", "en"), (2, "more", "en")]])
def test_few_labels(spark, rows):
    got = langid.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] in ("und", "en") for r in got)


def test_windows():
    rows, used = langid.windows(b"x" * 600)
    assert rows.shape == (3, 256) and used.tolist() == [256, 256, 88]
    assert langid.normalise("Ab--C  1é") == "ab c é".encode()
