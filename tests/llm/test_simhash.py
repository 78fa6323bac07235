import random
import re

import numpy as np
import xxhash

from threadloom.llm import simhash
from threadloom.llm.components import connected_components

from .common import docs, plain


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[a : a + 4]) for a in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_groups(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def texts():
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 40)) for _ in range(r.randint(1, 300))) for _ in range(40)]
    near = [t + f" tail{k}" for k, t in enumerate(base[:20])] + [t.upper() for t in base[:5]]
    return base + near + ["", None, " \t ", "one", "ÀB àb\xa0c", "x " * 5000] + base[:3]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in texts()] == [slow_print(t) for t in texts()]


def test_groups(spark):
    rows = list(enumerate(texts())) + [(0, texts()[0])]
    want = slow_groups({i: slow_print(t) for i, t in rows}, 4)
    got = simhash.near_groups(docs(spark, plain(rows))).collect()
    assert len(got) == len(rows)
    assert all(g["component_id"] == want[g["doc_id"]] and g["fingerprint"] == f"{slow_print(dict(rows)[g['doc_id']]):016x}" for g in got)
    kept = simhash.drop_near_copies(docs(spark, plain(rows)))
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted(set(want.values())) and "spans" in kept.columns


def test_links_in_many_strata(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.r_[base, near, near ^ np.uint64(0b111)])
    want = slow_groups({int(v): int(v) for v in values}, 4)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for rows in (1_000_000, 37):
        roots = connected_components(simhash.near_links(nodes, 4, rows), "u", "v").collect()
        group = {x["node"] & (1 << 64) - 1: x["root"] for x in roots}
        pairs = {(a, b) for a in want for b in want if a < b and want[a] == want[b]}
        assert all(group[a] == group[b] for a, b in pairs)
        assert len({group.get(v, v) for v in want}) == len(set(want.values()))


def test_small_tiles(monkeypatch):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    values = np.unique(np.r_[base, *(base ^ np.uint64(m) for m in (1, 3, 0x10101, 0xF, 0x1F))])
    want = slow_groups({int(v): int(v) for v in values}, 4)
    for pairs in (0, 50, 1 << 60):
        monkeypatch.setattr(simhash, "LARGE_PAIRS", pairs)
        for left, right in ((values, None), (values[::2], values[1::2])):
            u, v = simhash.linked(left, right, 4)
            root = {int(x): int(x) for x in values}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                assert want[a] == want[b]
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if right is None:
                assert all(find(x) == want[x] for x in root)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1100)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame([*edges, (5, None)], "a long, b long"), "a", "b").collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_empty(spark):
    assert simhash.near_groups(docs(spark, [])).collect() == []
    got = simhash.near_groups(docs(spark, plain([(None, "a b"), (None, None), (4, "")]))).collect()
    assert sorted((g["doc_id"] or -1, g["component_id"] or -1) for g in got) == [(-1, -1), (-1, 4), (4, 4)]
