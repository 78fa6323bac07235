"""Near copies by shingles of five words and a similarity of 0.8, against all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from threadloom.llm import simhash

from .common import docs, plain


def shingles(text, k=5):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def slow_print(text):
    """128 bits, each the majority over the hashes of all shingles."""
    counted, n = [0] * 128, 0
    for x in shingles(text):
        h = int.from_bytes(xxhash.xxh3_128_digest(x.encode(), 42), "little")
        n += 1
        for k in range(128):
            counted[k] += h >> k & 1
    return sum(1 << k for k in range(128) if 2 * counted[k] > n)


def slow_groups(prints, radius):
    """id -> smallest id that can be reached over links."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_prints():
    for text in ("", None, "one", "a b c d e", "The quick brown fox jumps over the lazy dog " * 3, "é x\u00a0y z w v"):
        assert int.from_bytes(simhash.wide_fingerprint(text), "little") == slow_print(text)
    assert simhash.radius_of(0.8) == 26


def test_links_against_all_pairs():
    r = np.random.default_rng(5)
    for _ in range(20):
        base = r.integers(0, 2**63, (60, 2), dtype=np.uint64)
        flips = np.zeros((60, 2), np.uint64)
        for row in range(30, 60):
            for bit in r.choice(128, r.integers(0, 40), replace=False):
                flips[row, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        halves = np.concatenate([base, base ^ flips])
        side = np.r_[np.zeros(60, np.int8), np.ones(60, np.int8)]
        apart = np.bitwise_count(halves[:, None] ^ halves[None]).sum(axis=2)
        for sides in (None, side):
            near = apart <= 26
            if sides is not None:
                near &= sides[:, None] != sides[None]
            prints = dict(enumerate(range(120)))
            root = {i: i for i in prints}

            def top(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = top(int(i)), top(int(j))
                root[max(a, b)] = min(a, b)
            u, v = simhash.linked_wide(halves, sides, 26)
            mine = simhash._Forest(120)
            mine.join(u, v)
            assert mine.roots(np.arange(120)).tolist() == [top(i) for i in range(120)]


def test_blocks(spark):
    src = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(x["doc_id"], x["text"]) for x in src]
    prints = {i: slow_print(t) for i, t in rows}
    nodes = spark.createDataFrame([(bytearray(p.to_bytes(16, "little")),) for p in set(prints.values())], "fp binary")
    links = simhash.copy_links(nodes, 26, block_rows=40).collect()
    edges = {(bytes(x["u"]), bytes(x["v"])) for x in links}
    want = slow_groups(prints, 26)
    mine = simhash._Forest(len(prints))
    at = {p.to_bytes(16, "little"): k for k, p in enumerate(sorted(set(prints.values())))}
    mine.join(*(np.array([at[e[k]] for e in edges]) for k in (0, 1)))
    roots = mine.roots(np.arange(len(prints)))
    want = slow_groups(prints, 26)
    assert len({roots[at[p.to_bytes(16, "little")]] for p in prints.values()}) == len(set(want.values()))
    assert all((int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() for a, b in edges)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_all_pairs_of_sets(spark, sf):
    """Whatever goes is similar to a text that stays and comes before it; of similar pairs nine in ten at least don't both stay."""
    rows = {x["doc_id"]: x["text"] for x in pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i] or "", i)
    sets = {i: frozenset(shingles(rows[i])) for i in first.values()}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    common = Counter()
    for ids in by_shingle.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    similar = [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    stays = {r["doc_id"] for r in simhash.drop_similar(docs(spark, plain(list(rows.items()))), most_shingles=5000).collect()}
    near = {i: [] for i in sets}
    for a, b in similar:
        near[max(a, b)].append(min(a, b))
    gone = set(sets) - stays
    assert stays <= set(sets) and all(any(j in stays for j in near[i]) for i in gone)
    assert sum(a in stays and b in stays for a, b in similar) <= len(similar) // 10 and gone


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_groups_do_not_chain(spark, most):
    """Of a chain of texts, each similar to the next, those stay that are similar to none before that stays; in one task and in rounds."""
    words = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(words[2 * i : 2 * i + 40]) for i in range(1, 9)} | {20 + i: " ".join([f"x{i}"] * i) for i in range(4)} | {30: None, 31: ""}
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    kept = []
    for i in sorted(texts):
        if all(jaccard(sets[i], sets[j]) < 0.8 for j in kept):
            kept.append(i)
    rows = spark.createDataFrame([(bytearray(b"r"), (False, i), bytearray(str(i).encode()), t) for i, t in texts.items()], "root binary, first struct<none: boolean, id: long>, digest binary, text string")
    got = simhash._distinct_in_groups(simhash.shingle_sets(rows, 5), 0.8, most).collect()
    assert sorted(int(bytes(r["digest"])) for r in got) == kept and len(kept) < len(texts)
