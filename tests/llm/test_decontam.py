import hashlib
import random
import re

import numpy as np
import pytest

from threadloom.llm import decontam

from .common import docs, plain

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(texts, items, window=10):
    split = lambda t: WORD.findall((t or "").encode().lower())
    out = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            seq = split(body)
            size = min(window, len(seq))
            for a in range(len(seq) - size + 1) if seq else []:
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == seq[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), sha, bool(hit)))
    return out


def tables():
    r = random.Random(4)
    say = lambda n, v=6: " ".join(r.choice("abcdefghijkl"[:v]) for _ in range(n))
    items = [(i, say(r.randint(10, 30), 12)) for i in range(12)] + [(20, "Solo-Word"), (21, "é1 b2 C3"), (22, ""), (23, None), (24, items_dup := say(15, 12)), (30, items_dup)]
    bodies = [b for _, b in items if b]
    texts = [say(80, 12) + " " + r.choice(bodies) + "! " + say(30, 12) for _ in range(25)]
    texts += [" ".join(r.choice(bodies).split()[2:13]) for _ in range(10)] + ["", None, "solo word", "É1 b2 c3", "é1 b2 c3", say(3), items_dup + " " + items_dup]
    return texts, items


@pytest.mark.parametrize("block", [8_000_000, 100])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 300)
    texts, items = tables()
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    bench = spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, spans string")
    got = decontam.contamination(docs(spark, plain(rows)), bench, block_bytes=block).collect()
    want = slow([t for _, t in rows], items)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, map(tuple, got))) == sorted(key((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_drop_and_empty(spark):
    texts, items = tables()
    d = docs(spark, plain(list(enumerate(texts))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in decontam.drop_contaminated(d, bench).collect()}
    assert kept == {i for i, w in enumerate(slow(texts, items)) if not w[-1]}
    assert decontam.contamination(d, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0
    assert decontam.contamination(d.limit(0), bench).count() == 0


def test_suffix_array():
    r = np.random.default_rng(2)
    symbols = r.integers(0, 4, 500)
    runs = decontam.run_lengths(symbols)
    for least in (1, 5):
        array = decontam.suffix_array(symbols, least, 10)
        assert sorted(array) == [i for i in range(500) if runs[i] >= least]
        told = [tuple(symbols[i : i + min(10, runs[i])]) for i in array]
        assert told == sorted(told)


def maximal(text, items, window=10):
    """All pairs of places from which item and document agree for a window at least, and not one word before."""
    split = lambda t: WORD.findall((t or "").encode().lower())
    words, out = split(text), []
    for item, body in items:
        seq = split(body)
        for j in range(len(seq)):
            for p in range(len(words)):
                n = 0
                while j + n < len(seq) and p + n < len(words) and seq[j + n] == words[p + n]:
                    n += 1
                if n >= min(window, len(seq)) and not (j and p and seq[j - 1] == words[p - 1]):
                    out.append((str(item), j, p, n))
    return sorted(out)


@pytest.mark.parametrize("block", [8_000_000, 100])
def test_longest_matches(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 300)
    texts, items = tables()
    a, b = items[0][1].split(), items[1][1].split()
    texts = [t for t in texts if t] + [" ".join([*a[:12], *b[:12]])]
    got = decontam.matches(docs(spark, plain(list(enumerate(texts)))), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    for r in got.collect():
        assert [tuple(x) for x in r["longest"]] == maximal(texts[r["doc_id"]], items)


def test_passes_run_one_worker(spark):
    texts, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = decontam.matches(docs(spark, plain(list(enumerate(texts)))), bench, block_bytes=100)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
