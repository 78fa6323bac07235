"""Merkle manifest of a dataset: a root over all rows, a subroot for each group, and a proof for every row.

Rows become leaves, the leaves of a group lie in the order of their ids, and ``fanout`` nodes that stand together make the node above them; the last
ones of a level make one too, however few they are, without padding. Leaves are numbered by one distributed sort and cut into blocks of equal size.
A block's task pushes its leaves on a stack of open runs, a run for each level: a run that is complete is carried to the level above, and a run that
reaches over the block's edge stays open. What stays open (the block's peaks) is pushed on the same kind of stack by tasks that each take some
blocks that follow one another, and so on until a group is one peak, its subroot. Going back down, every peak learns the way from it to the
root; with those ways, each block's task proves its leaves for itself. Subroots are the leaves of one more such tree.

A task holds a block of leaves or the peaks of ``SPAN`` blocks, a few for each level; nothing but the counts of sorted partitions reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.llm.common import BROADCAST_ROWS, sized, written

FANOUT = 3
#: Leaves of a block, and blocks whose peaks a task merges.
BLOCK_ROWS, SPAN = 32_768, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<place: int, others: array<string>>>"


def digest_of_parts(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: Iterable[str | Column]) -> Column:
    """The digest of a row: each value as the number of its UTF-8 bytes, a colon and the value; null as a dash."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def widths(n: int, fanout: int) -> list[int]:
    """How many nodes each level of a tree of ``n`` leaves has, up to its root."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


class Mountains:
    """The stack: nodes of one tree, pushed from left to right, become the nodes above them as soon as their run is complete."""

    def __init__(self, n: int, fanout: int):
        self.fanout, self.widths = fanout, widths(n, fanout)
        self.runs: list[list[int]] = [[] for _ in self.widths]
        self.nodes: dict[tuple[int, int], str] = {}
        self.peaks: list[tuple[int, int]] = []

    def push(self, level: int, index: int, digest: str) -> None:
        while True:
            self.nodes[level, index] = digest
            if self.widths[level] == 1:
                self.peaks.append((level, index))
                return
            run = self.runs[level]
            if run and run[-1] // self.fanout != index // self.fanout:
                self._open(level)
            run.append(index)
            first, last = self.reach(level, index)
            if index < last:
                return
            if run[0] > first:  # it began in an earlier block
                self._open(level)
                return
            digest = digest_of_parts(self.nodes[level, i] for i in run)
            run.clear()
            level, index = level + 1, index // self.fanout

    def reach(self, level: int, index: int) -> tuple[int, int]:
        """The first and the last node of the run that holds this one."""
        first = index - index % self.fanout
        return first, min(first + self.fanout, self.widths[level]) - 1

    def _open(self, level: int) -> None:
        self.peaks += [(level, i) for i in self.runs[level]]
        self.runs[level].clear()

    def close(self) -> None:
        """What is still open, are peaks."""
        for level in range(len(self.runs)):
            self._open(level)

    def way(self, level: int, index: int, peaks: set[tuple[int, int]]) -> tuple[list[tuple[int, list[str]]], tuple[int, int]]:
        """From a node to the peak above it: its place in each run with the others there, and the peak."""
        steps = []
        while (level, index) not in peaks:
            first, last = self.reach(level, index)
            steps.append((index - first, [self.nodes[level, i] for i in range(first, last + 1) if i != index]))
            level, index = level + 1, index // self.fanout
        return steps, (level, index)


def fold(digest: str, steps: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its way lead to."""
    for place, others in steps:
        digest = digest_of_parts([*others[:place], digest, *others[place:]])
    return digest


def _mountains(part: pa.Table, fanout: int) -> dict[str, Mountains]:
    """A stack for each tree, of ``part(tree, n, level, index, digest)``."""
    found: dict[str, Mountains] = {}
    rows = list(zip(*(part.column(c).to_pylist() for c in ("tree", "n", "level", "index", "digest")), strict=True))
    for tree, n, level, index, digest in sorted(rows, key=lambda x: (x[3] * fanout ** x[2], -x[2])):
        if tree not in found:
            found[tree] = Mountains(n, fanout)
        found[tree].push(level, index, digest)
    for x in found.values():
        x.close()
    return found


@dataclass(frozen=True)
class Forest:
    """Trees whose leaves are placed: ``leaves(tree, n, level, index, digest, block, ...)``, and for each peak of a block its way to
    the tree's root: ``ways(tree, block, level, index, steps, top)``."""

    leaves: DataFrame
    ways: DataFrame
    fanout: int

    def nodes(self) -> DataFrame:
        """(tree, level, index, digest) of all nodes above the leaves that lie within a block: the records that the stacks leave."""

        def work(part: pa.Table) -> pa.Table:
            found = [(tree, *at, digest) for tree, m in _mountains(part, fanout).items() for at, digest in m.nodes.items() if at[0]]
            return _rows(found, "tree level index digest")

        fanout = self.fanout
        return self.leaves.groupBy("block").applyInArrow(work, "tree string, level int, index long, digest string")

    def each(self, kind: str, told: Callable[[dict, list[tuple[int, list[str]]], str], dict]) -> DataFrame:
        """What ``told(leaf, steps, top)`` makes of each leaf, its way to the tree's root and that root."""
        fanout, schema = self.fanout, to_arrow_schema(T.StructType.fromDDL(kind))

        def work(part: pa.Table, ways: pa.Table) -> pa.Table:
            above = {(w["tree"], w["level"], w["index"]): ([(s["place"], s["others"]) for s in w["steps"]], w["top"]) for w in ways.to_pylist()}
            trees = _mountains(part, fanout)
            peaks = {t: set(m.peaks) for t, m in trees.items()}
            out = []
            for leaf in part.to_pylist():
                steps, peak = trees[leaf["tree"]].way(0, leaf["index"], peaks[leaf["tree"]])
                more, top = above[leaf["tree"], *peak]
                out.append(told(leaf, steps + more, top))
            return pa.Table.from_pylist(out, schema)

        return self.leaves.groupBy("block").cogroup(self.ways.groupBy("block")).applyInArrow(work, kind)


def forest(rows: DataFrame, fanout: int = FANOUT, block_rows: int = BLOCK_ROWS, span: int = SPAN) -> Forest:
    """The trees of ``rows(tree, place, digest, ...)``: leaves in the order of place (nulls first), then digest. ``tree`` isn't null."""
    spark = rows.sparkSession
    order = ("tree", F.asc_nulls_first("place"), "digest")
    lined = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-lined")
    parts = lined.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before = list(accumulate((p["n"] for p in parts), initial=0))[:-1]
    starts = spark.createDataFrame([(p["part"], b) for p, b in zip(parts, before, strict=True)], "part long, before long")
    numbered = lined.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    numbered = numbered.withColumn("g", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at", "place")
    trees = written(numbered.groupBy("tree").agg(F.min("g").alias("first"), F.count("*").alias("n")), "merkle-trees")
    leaves = numbered.join(sized(trees, BROADCAST_ROWS // 4), "tree").select(
        F.lit(0).alias("level"), (F.col("g") - F.col("first")).alias("index"), F.expr(f"g div {int(block_rows)}").alias("block"), "n", *(c for c in rows.columns if c != "place")
    )
    leaves = written(leaves, "merkle-leaves")

    def peaks_of(part: pa.Table) -> pa.Table:
        block = part.column("block")[0].as_py() if part.num_rows else 0
        found = [(tree, m.widths[0], block, *at, m.nodes[at]) for tree, m in _mountains(part, fanout).items() for at in m.peaks]
        return _rows(found, "tree n block level index digest")

    kind = "tree string, n long, block long, level int, index long, digest string"
    now = written(leaves.select("tree", "n", "block", "level", "index", "digest").groupBy("block").applyInArrow(peaks_of, kind), "merkle-peaks")
    base, merged = now, []
    blocks = -(-sum(p["n"] for p in parts) // block_rows)
    while True:
        blocks = -(-blocks // span)
        now = written(_merge(now.withColumn("block", F.expr(f"block div {int(span)}")), fanout), "merkle-merged")
        merged.append(now)
        if blocks <= 1:
            break
        now = now.select("tree", "n", "block", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_digest").alias("digest")).distinct()
    ways = merged[-1].select("tree", "level", "index", "steps", F.col("up_digest").alias("top"))
    for below in reversed(merged[:-1]):
        above = ways.select("tree", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("steps").alias("more"), "top")
        ways = below.join(above, ["tree", "up_level", "up_index"]).select("tree", "level", "index", F.concat("steps", "more").alias("steps"), "top")
    ways = base.select("tree", "block", "level", "index").join(ways, ["tree", "level", "index"])
    return Forest(leaves, written(ways, "merkle-ways"), fanout)


def _rows(found: list[tuple], names: str) -> pa.Table:
    kinds = {"tree": pa.string(), "digest": pa.string(), "up_digest": pa.string(), "level": pa.int32(), "up_level": pa.int32()}
    kinds["steps"] = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
    columns = list(zip(*found, strict=True)) if found else [()] * len(names.split())
    return pa.table({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in zip(names.split(), columns, strict=True)})


def _merge(peaks: DataFrame, fanout: int) -> DataFrame:
    """The peaks of blocks that follow one another, each with its way to the peak above it that they have together."""

    def work(part: pa.Table) -> pa.Table:
        block, found = part.column("block")[0].as_py() if part.num_rows else 0, []
        for tree, m in _mountains(part, fanout).items():
            tops = set(m.peaks)
            for at in zip(part.column("level").to_pylist(), part.column("index").to_pylist(), strict=True):
                steps, up = m.way(*at, tops)
                found.append((tree, m.widths[0], block, *at, *up, m.nodes[up], [{"place": p, "others": o} for p, o in steps]))
        return _rows(found, "tree n block level index up_level up_index up_digest steps")

    kind = f"tree string, n long, block long, level int, index long, up_level int, up_index long, up_digest string, steps {_STEPS}"
    return peaks.groupBy("tree", "block").applyInArrow(work, kind)


def manifest(
    docs: DataFrame,
    columns: Iterable[str] = COLUMNS,
    group_col: str = "source",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    block_rows: int = BLOCK_ROWS,
    span: int = SPAN,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row.

    proof_sha256: of the digests that stand beside the row's on the way to the root, from left to right and upward, in one text.
    ``tampered`` gives some columns other values: the folded root is made from such a row and the way that was recorded, and verified
    says whether it is the root. Null groups come first, as a group; null ids come first in theirs. Rows of equal ids lie in the order of their
    leaves, and repeated rows have leaves of their own. An empty table gives an empty result.
    """
    columns = list(columns)
    other = leaf_of([(tampered or {}).get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))  # order and null are those of the group
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("place"), leaf_of(columns).alias("digest"), other.alias("other"))
    leaves = leaves.withColumn("id", F.col("place"))
    groups = forest(written(leaves, "merkle-rows"), fanout, block_rows, span)
    tops = groups.ways.select("tree", "top").distinct().select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("top").alias("digest"), F.col("tree").alias("group"))
    above = forest(written(tops, "merkle-subroots"), fanout, block_rows, span)
    ways = above.each(f"group string, root string, more {_STEPS}", lambda leaf, steps, top: {"group": leaf["group"], "root": top, "more": [{"place": p, "others": o} for p, o in steps]})
    ways = written(ways, "merkle-tops")
    whole = groups.ways.join(sized(ways, BROADCAST_ROWS // 100), F.col("tree") == F.col("group"))
    whole = whole.select("tree", "block", "level", "index", F.concat("steps", "more").alias("steps"), F.concat("root", "top").alias("top"))

    def told(leaf: dict, steps: list[tuple[int, list[str]]], top: str) -> dict:
        proof = digest_of_parts(d for _, others in steps for d in others)
        root, folded = top[:64], fold(leaf["other"], steps)
        return {"doc_id": leaf["id"], "leaf": leaf["digest"], "subroot": top[64:], "root": root, "proof_sha256": proof, "folded_root": folded, "verified": folded == root}

    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return Forest(groups.leaves, whole, fanout).each(kind, told)
