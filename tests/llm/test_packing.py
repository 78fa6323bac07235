import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadloom.llm import packing

from .common import docs, plain


def check(need, capacity):
    groups = packing.pack(dict(need), capacity)
    have = Counter()
    for group, n in groups:
        assert sum(x * k for x, k in group) <= capacity
        for x, k in group:
            have[x] += k * n
    assert have == Counter({k: v for k, v in need.items() if v})
    return sum(n for _, n in groups)


@pytest.mark.parametrize("seed", range(4))
def test_pack(seed):
    r = random.Random(seed)
    need = Counter(min(64, 1 + int(r.expovariate(1 / 20))) for _ in range(r.choice([1, 30, 3000])))
    low = -(-sum(k * v for k, v in need.items()) // 64)
    best = sum(n for _, n in packing.best_fit(need, 64))
    assert low <= check(need, 64) <= min(best, low * 1.05 + 2)


def test_program_beats_best_fit():
    need = {50: 10, 41: 10, 34: 20, 25: 20, 16: 10}  # best fit, longest first, leaves gaps here
    assert check(need, 100) <= sum(n for _, n in packing.best_fit(need, 100))


def test_knapsack():
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(r.integers(1, 12, 5))
        value = r.random(len(lengths))
        got = packing.knapsack(value, lengths, 20)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(value[i] + best[c - n] for i, n in enumerate(lengths) if n <= c)])
        assert sum(value[k] * n for k, n in got.items()) == pytest.approx(best[20])
        assert sum(lengths[k] * n for k, n in got.items()) <= 20


def test_documents(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["naïve", "cat", "3", "x" * 30, "<|endoftext|>"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "word " * 900), (3, texts[3]), (None, "null id"), (104, " " * 3000)]
    got = packing.pack_documents(docs(spark, plain(rows)), capacity=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for k, stop in enumerate(range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)):
            want[i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start = stop
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    at = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at.get(x["sequence_id"], 0)
        at[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(at.values()) <= 64
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_long_white_space():
    t = packing.Tokens()
    text = "a" + " " * 1_000_000 + "b"
    assert t.ids(text) == Tokenizer.from_file(t.path).encode(text, add_special_tokens=False).ids


def fewest(pieces, capacity):
    """Exact bin packing by search."""
    pieces, low = sorted(pieces, reverse=True), -(-sum(pieces) // capacity)
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0] or best[0] == low:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            j = rooms.index(room)
            go(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best[0]


def test_exact_optima():
    r = random.Random(4)
    for _ in range(60):
        capacity = r.choice([30, 60, 100])
        pieces = [r.randint(capacity // 8, capacity * 6 // 10) for _ in range(r.randint(1, 11))]
        got = packing.pack_report(Counter(pieces), capacity)
        assert got.sequences == fewest(pieces, capacity) and got.at_least <= got.sequences


def test_program_is_solved():
    r = random.Random(2)
    need = Counter(r.randint(600, 899) for _ in range(50_000))
    got = packing.pack_report(dict(need))
    assert check(need, 2048) == got.sequences
    assert got.gap <= packing.GAP and got.by_program > 0.9
    assert got.sequences < 0.96 * sum(n for _, n in packing.best_fit(dict(need), 2048)) and got.sequences < 1.02 * got.at_least


def test_master_and_bound():
    """Against the optimum of a small program by hand: halves, thirds and a mix of both."""
    cover = np.array([[2, 0, 1], [0, 3, 1]]) / np.array([[10.0], [12.0]])
    x, price = packing.master(cover)
    assert x.sum() == pytest.approx(9, abs=1e-3) and price.sum() == pytest.approx(9, abs=1e-3)
    assert (cover @ x).min() > 1 - 1e-5
    program = packing.configuration_program({50: 10, 33: 12}, 100)
    assert program.value == pytest.approx(9, abs=0.02) and 8.9 < program.bound <= 9.001 and program.sure <= 9.001


def lengths_of(kind, n=20_000):
    r = np.random.default_rng(12)
    if kind == "lognormal":
        return np.clip(np.exp(r.normal(6, 0.9, n)).astype(int), 1, 2048)
    if kind == "short":
        return r.integers(2, 701, n)
    if kind == "triples":
        return r.integers(600, 900, n)
    if kind == "all":
        return r.integers(1, 2049, n)
    return np.r_[r.integers(1000, 1100, n // 3), r.integers(300, 420, n - n // 3)]


@pytest.mark.parametrize("kind", ["lognormal", "short", "triples", "all", "two kinds"])
def test_never_worse_than_best_fit(kind):
    need = Counter(lengths_of(kind).tolist())
    got = packing.pack_report(dict(need))
    have = Counter()
    for group, n in got.groups:
        assert sum(x * k for x, k in group) <= packing.CAPACITY
        for x, k in group:
            have[x] += k * n
    alone = sum(n for _, n in packing.best_fit(dict(need), packing.CAPACITY))
    assert have == need and got.at_least <= got.sequences == sum(n for _, n in got.groups) <= alone
    if kind in ("triples", "two kinds"):  # here the program is what helps
        assert got.sequences < 0.98 * alone and got.by_program > 0.8
