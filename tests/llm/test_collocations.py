"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter

import pytest

from threadloom.llm import collocations

from .common import docs


def slow(rows, least, words=4, share=80, top=2000):
    """rows of (id, text, lang) -> (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    dropped = {(p[0], *p[i : i + m]) for p, a in found.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * a >= share * f[(p[0], *p[i : i + m])]}
    scored = []
    for p, a in found.items():
        if p not in dropped:
            score, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            scored.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def made():
    r = random.Random(1)
    idioms = ["As Far as I", "by and large", "in in in", "Éa é", "of the", "a\x00b c", "(so on)"]
    rows = []
    for i in range(300):
        parts = [r.choice(idioms) if r.random() < 0.6 else r.choice("the of a in on é x1 - to".split()) for _ in range(r.randint(0, 40))]
        text = "".join(p + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "?"]) for p in parts)
        rows.append((r.choice([i, 3, None]), r.choice([text, text, text, None, "", "..", text[::2]]), r.choice(["en", "en", "und", None, "de", ""])))
    return rows + [rows[0]] * 3 + [(9, "in " * 50_000, "en")]


@pytest.mark.parametrize("most_bytes", [32_000_000, 0])
def test_against_counts(spark, most_bytes):
    """By sent tables and by joins: nulls, repeated rows, a very long text, phrases inside others, ties, cuts by score."""
    rows = made()
    got = collocations.collocations(docs(spark, rows).repartition(5), least=12, top=8, most_bytes=most_bytes)
    want = slow(rows, 12, top=8)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({x[0] for x in want}) == 4 and max(x[1] for x in want) == 8 and {len(x[2].split()) for x in want} == {2, 3, 4}


def test_parents(spark):
    """Parents of a phrase are the phrases of one word less at its beginning and end, down to words."""
    every, totals = collocations.phrases(docs(spark, [(1, "a b c d. a b c d", "en"), (2, "x", None)]), least=2)
    rows = {(r["words"], r["id"]): r for r in every.collect()}
    top = next(r for r in rows.values() if r["words"] == 4)
    left, right = rows[3, top["left"]], rows[3, top["right"]]
    assert (top["phrase"], left["phrase"], right["phrase"]) == ("a b c d", "a b c", "b c d")
    assert top["begins"] == [2, 2, 2] and top["ends"] == [2, 2, 2] and rows[2, left["right"]]["phrase"] == "b c"
    assert {tuple(r) for r in totals.collect()} == {("en", 8), ("und", 1)}


def test_empty(spark):
    assert collocations.collocations(docs(spark, [])).collect() == []
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def test_large_scores(spark):
    a, b, c = 9_000_000_000_000_001, 9_000_000_000_000_003, 9_000_000_000_000_007
    df = spark.createDataFrame([(2, a, [b], [c])], "words int, f long, begins array<long>, ends array<long>")
    assert df.select(collocations.best_cut("f", "words").alias("c")).first()["c"]["score"] == 2_000_000 * a // (b + c)
