"""Removal of repeated passages against sets of all windows."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from threadloom.llm import repeats
from threadloom.llm.queries import op11_prefix_doubling

from .common import docs, plain


def slow(rows, length=50):
    """(doc_id, n_bytes, spans, kept) of each row."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if i is not None and least.get(w, i) >= i:
                least[w] = i
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if (gone[k] if k < len(b) else 0) != (gone[k - 1] if k else 0)]
        out.append((i, len(b), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in repeats.without_repeats(df, **more).collect()), key=repr)


def test_against_all_windows(spark):
    """Passages that many texts share whole and in part, at borders of texts and over each other; texts of few bytes; other lengths and first prefixes."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)] + ["x" * 300, "ab" * 120, "é" * 70]
    rows = []
    for i in range(150):
        parts = [p[a : a + r.randint(20, 400)] if r.random() < 0.7 else " ".join(word() for _ in range(20)) for p in r.choices(passages, k=r.randint(0, 5)) for a in [r.randint(0, 30)]]
        rows.append((r.choice([i, i, i, None, 7]), "|".join(parts)))
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), (205, passages[0]), (205, passages[0]), (206, passages[0] * 2)]
    df = docs(spark, plain(rows)).repartition(7)
    want = slow(rows)
    assert got(df) == want
    assert got(df, start=8) == want  # 8, 16, 32, 50
    assert got(df, length=20, gram=7, start=20) == slow(rows, 20)
    assert got(df, length=9) == slow(rows, 9)
    assert sum(len(x[2]) for x in want) > 100
    assert repeats.without_repeats(docs(spark, [])).collect() == []


def test_long_texts(spark, monkeypatch):
    """Texts are taken in parts and in runs of several; the cuts don't show."""
    monkeypatch.setattr(repeats, "_PART", 1000)
    monkeypatch.setattr(repeats, "_RUN", 300)
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(5000))
    rows = [(5, base), (3, base[700:1300] + "?" + base[3000:4300]), (4, "!" + base), (9, base[:900] + base[950:]), (1, base[2500:2560]), (10, base[::-1])]
    data = [t.encode() for _, t in rows]
    covered = {i: set() for i in range(len(data))}
    for _, _, text, first, last, _, _ in repeats._anchors(pa.array(data, pa.binary()), 50, 24):
        for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True):
            covered[t].update(range(a, b + 1))
    assert all(covered[i] == set(range(len(b) - 49)) for i, b in enumerate(data))
    assert got(docs(spark, plain(rows))) == slow(rows)


def test_filter_holds_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bits = repeats._filter(keys)
    mine = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert repeats._known(bits, mine).all()
    assert repeats._known(bits, np.arange(1, 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.1
    assert repeats._filter(keys.limit(0)).sum() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    want = sorted((i, n, n - len(k), len(s), sha256(k).hexdigest()) for i, n, s, k in slow(rows))
    assert sorted(tuple(r) for r in op11_prefix_doubling(spark, "/root/testdata/sf0.001").collect()) == want
    assert any(x[2] for x in want)
