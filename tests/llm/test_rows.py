"""Filtering stages judge rows, not ids: repeated and null ids in each of them, empty tables and clashing columns."""

from collections import Counter

from threadloom.llm import decontam, langid, simhash

from .common import docs, plain

ITEM = "one two three four five six seven eight nine ten eleven"


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_decontamination(spark):
    rows = [(5, f"so {ITEM} it is"), (5, "clean text"), (None, ITEM), (None, "clean too"), (6, None), (6, ""), (7, ITEM), (7, ITEM), (8, "clean"), (8, "clean")]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontam.drop_contaminated(docs(spark, plain(rows)), bench)
    assert kept(got) == Counter(r for r in rows if ITEM not in (r[1] or ""))
    assert got.columns == docs(spark, []).columns
    assert decontam.drop_contaminated(docs(spark, []), bench).collect() == []


def test_language(spark):
    good = [(i, f"the cat and the dog were there with all of them {i}", "en") for i in range(60)]
    good += [(100 + i, f"der Hund und die Katze sind nicht mehr so jung {i}", "de") for i in range(60)]
    odd = [(7000, None, "en"), (7000, good[0][1], "en"), (None, "12 34", "en"), (None, good[1][1], "en"), (7001, "", "en"), (7001, good[60][1], "de"), (7001, good[60][1], "de")]
    got = kept(langid.keep_identified(docs(spark, good + odd)))
    assert got == Counter((i, t) for i, t, _ in good + odd if t and t != "12 34")
    assert langid.keep_identified(docs(spark, [])).collect() == []


def test_near_copies(spark):
    a, b = "a long enough text of several words to be told " * 4, "quite another text that has nothing of the first in it " * 4
    rows = [(3, a), (3, b), (9, a), (None, a), (None, b), (2, "x y z"), (2, "x y z"), (None, "p q r"), (None, "p q r"), (4, None), (5, ""), (None, "")]
    for drop in (simhash.drop_near_copies, simhash.drop_similar):
        got = kept(drop(docs(spark, plain(rows))))
        assert got == Counter([(3, a), (3, b), (2, "x y z"), (None, "p q r"), (4, None)])
        assert drop(docs(spark, [])).collect() == []
