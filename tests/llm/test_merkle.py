"""Merkle manifests against trees that are built level by level, with every tree size around the edges of blocks."""

import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle

from .common import docs

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def way(nodes, i, fanout):
    """Siblings of a leaf, a list for each level with the place in it, and the top."""
    steps = []
    while len(nodes) > 1:
        first = i - i % fanout
        run = nodes[first : first + fanout]
        steps.append((i - first, run[: i - first] + run[i - first + 1 :]))
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        i //= fanout
    return steps, nodes[0]


def slow(rows, fanout=3):
    """rows of COLUMNS -> (doc_id, leaf, subroot, root, proof, folded, verified), where tampering deletes line feeds of every other text."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    groups = []
    for _, found in groupby(sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, leaf_of(r))), key):
        groups.append(list(found))
    tops = [way([leaf_of(r) for r in g], 0, fanout)[1] for g in groups]
    out = []
    for k, g in enumerate(groups):
        more, root = way(tops, k, fanout)
        for i, r in enumerate(g):
            steps = way([leaf_of(x) for x in g], i, fanout)[0] + more
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            folded = leaf_of(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
            for place, others in steps:
                folded = h(*others[:place], folded, *others[place:])
            proof = h(*(x for _, others in steps for x in others))
            out.append((r[0], leaf_of(r), tops[k], root, proof, folded, folded == root))
    return sorted(out, key=str)


def made(df, **more):
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    bad = {"text": F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(df, tampered=bad, **more)


@pytest.mark.parametrize("fanout, block_rows, span", [(3, 7, 2), (2, 1000, 64)])
def test_against_levels(spark, fanout, block_rows, span):
    rows = [(i, f"s{n:02}", "en", n, f"line {i}\nmore" * (i % 3)) for n in (1, 2, 3, 4, 9, 10, 28) for i in range(1000 * n, 1000 * n + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = sorted((tuple(r) for r in made(df, fanout=fanout, block_rows=block_rows, span=span).collect()), key=str)
    assert got == slow(rows, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_hard_cases(spark):
    """Nulls in every column, repeated rows and ids, groups that differ from null by a hair, other columns of the same names as its own."""
    rows = [
        (None, None, None, None, None), (1, None, "en", 1, "a\n"), (1, "", "en", 1, "a\n"), (1, "-", None, 1, "a\n"), (1, "-", None, 1, "a\n"),
        (2, "é", "en", None, ""), (2, "é", "en", None, "b"), (None, "é", "en", 3, "x" * 100_000), (3, "z", "de", -5, "1:\n2:"), (4, "z", "de", 0, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("tree", "place", "digest", "block", "at", "g", "n", "leaf", "level", "index", "id", "other")})
    got = sorted((tuple(r) for r in made(df, block_rows=3, span=2).collect()), key=str)
    assert got == slow(rows)
    assert made(docs(spark, [])).collect() == []


def test_node_records(spark):
    """Each node above the leaves that lies in one block is recorded once, with the digest of what is below it."""
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = df.select(F.col("source").alias("tree"), F.col("doc_id").alias("place"), merkle.leaf_of(COLUMNS).alias("digest"))
    found = {(r["level"], r["index"]): r["digest"] for r in merkle.forest(leaves, block_rows=20).nodes().collect()}
    want = [leaf_of(r) for r in rows]
    assert found[1, 0] == h(*want[:3]) and found[2, 0] == h(*(h(*want[i : i + 3]) for i in (0, 3, 6)))
    assert (1, 6) not in found and found[1, 13] == h(want[39])  # leaves 18 to 20 lie in two blocks; a short run needs no padding


def test_a_changed_row_is_found(spark):
    steps, root = [(1, ["a", "c"]), (0, [])], h(h("a", "b", "c"))
    assert merkle.fold("b", steps) == root and merkle.fold("x", steps) != root
