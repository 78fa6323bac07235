"""Candidates for near copies: found by keys of the texts' sets, not by comparing all pairs, and none is lost."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from threadloom.llm import simhash

from .common import docs, plain
from .test_near_copies import jaccard, shingles


def components(n, pairs):
    forest = simhash._Forest(n)
    if pairs:
        forest.join(*(np.array(x) for x in zip(*pairs, strict=True)))
    return forest.roots(np.arange(n)).tolist()


def prints(r, n, bases=6):
    """Fingerprints around some bases, up to 45 bits off, so that some chain and some don't link; a few repeat."""
    made = r.integers(0, 2, (bases, 128))[r.integers(0, bases, n)]
    for row in made:
        row[r.choice(128, r.integers(0, 46), replace=False)] ^= 1
    made[n // 2 :: 7] = made[0]
    return np.packbits(made, axis=1).view("<u8")


@pytest.mark.parametrize("n", [0, 1, 2, 40, 400])
def test_pivots_against_all_pairs(n):
    r = np.random.default_rng(n)
    for bases in (1, 6, 100):
        halves = prints(r, n, bases) if n else np.zeros((0, 2), np.uint64)
        near = np.bitwise_count(halves[:, None] ^ halves[None]).sum(axis=2) <= 39
        want = components(n, [(i, j) for i, j in np.argwhere(near).tolist() if i < j])
        u, v = simhash.linked_by_pivots(halves, 39)
        assert components(n, list(zip(u.tolist(), v.tolist(), strict=True))) == want


@pytest.mark.parametrize("batch", [3, 10_000])
def test_keys_over_batches(spark, batch):
    """Rows of a key link as all pairs of them do, in one batch or over many; rows without a common key don't."""
    r = np.random.default_rng(3)
    halves = prints(r, 300)
    keys = [[int(x) for x in r.choice(60, 2)] + [1000] * (k % 3 == 0) for k in range(300)]
    keys[5] = []
    rows = [(*x, k) for x, k in zip(halves.view(np.int64).tolist(), keys, strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = simhash.copy_candidates(spark.createDataFrame(rows, "low long, high long, keys array<long>"), 39).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    place = {x.tobytes(): k for k, x in enumerate(halves)}  # rows that repeat a fingerprint are one
    own = [place[x.tobytes()] for x in halves]
    near = np.bitwise_count(halves[:, None] ^ halves[None]).sum(axis=2) <= 39
    want = [(own[i], own[j]) for i in range(300) for j in range(i) if near[i, j] and set(keys[i]) & set(keys[j])]
    assert want and components(300, want) == components(300, [(place[bytes(x["u"])], place[bytes(x["v"])]) for x in got])


def test_work_does_not_grow_with_pairs(spark, monkeypatch):
    """Unrelated texts share no key, so none is compared with another; similar ones share one."""
    r = random.Random(7)
    texts = [" ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(5, 200))) for _ in range(1000)]
    keys = np.concatenate([simhash.copy_sketch(t)[1] for t in texts])
    assert keys.size == 20_000 == np.unique(keys).size
    compared = []
    monkeypatch.setattr(simhash, "copy_links", lambda *a, **b: compared.append(a))
    words = texts[0].split()
    rows = [*enumerate(texts), (1000, texts[0] + " x"), (1001, texts[0].upper()), (1002, None), (1003, " ")]
    assert len(words) > 20
    got = {x["doc_id"] for x in simhash.drop_similar(docs(spark, plain(rows))).collect()}
    assert got == {*range(1000), 1002} and not compared


def test_texts_that_repeat_a_line(spark):
    """Sets are what is similar, however often a shingle is repeated."""
    r = random.Random(11)
    base = [" ".join(f"{k}a{r.randint(0, 10**6)}" for _ in range(120)) for k in range(10)]
    rows = [(i, t + " l1 l2 l3 l4 l5 l6") for i, t in enumerate(base)] + [(100 + i, t + " l1 l2 l3 l4 l5 l6" * 300) for i, t in enumerate(base)]
    assert all(jaccard(set(shingles(rows[i][1])), set(shingles(rows[10 + i][1]))) > 0.9 for i in range(10))
    assert sorted(x["doc_id"] for x in simhash.drop_similar(docs(spark, plain(rows))).collect()) == list(range(10))


def test_sketch():
    for text in ("one", "a b c d e", "The quick brown fox jumps over the lazy dog " * 3, "é x y z w v", "a b " * 40_000):
        halves, keys = simhash.copy_sketch(text)
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        again, same = simhash.copy_sketch("\n".join(words))
        assert halves.tolist() == again.tolist() and keys.tolist() == same.tolist() and keys.size == 20
        assert len(simhash._shingle_numbers(text, 5)) == len(set(shingles(text)))
    assert [x.tolist() for x in simhash.copy_sketch(" \t")] == [[0, 0], []] and simhash.set_radius(0.8) == 39


def test_all_similar_pairs_are_found(spark):
    """What stays is what stays where every pair of sets is compared, in the order of ids."""
    rows = {x["doc_id"]: x["text"] for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    sets, by_shingle, stays = {}, {}, set()
    for i in sorted(rows):
        mine = frozenset(shingles(rows[i]))
        others = {j for x in mine for j in by_shingle.get(x, ())} if mine else {j for j in stays if not sets[j]}
        if all(jaccard(mine, sets[j]) < 0.8 for j in others):
            stays.add(i)
            sets[i] = mine
            for x in mine:
                by_shingle.setdefault(x, []).append(i)
    assert {r["doc_id"] for r in simhash.drop_similar(docs(spark, plain(list(rows.items())))).collect()} == stays
