"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are made in Python from whole texts, distinct ones are dealt to strata of equal population
count, and every pair of strata whose counts differ by no more than the radius is compared exactly, tile by
tile, with numpy exclusive-or and bit counts. Tiles hold fingerprints with the same population counts in
each 16-bit word; a pair of tiles whose counts differ by more than the radius in sum is skipped, because
each differing bit changes one of these counts by one. A task hands on a spanning forest of what it linked,
never the pairs themselves.

Near copies by similarity are texts that share a key and whose fingerprints of 128 bits are near. A text has 20 keys, each of the least
values that three hashes take on its set of shingles; two sets share each with the cube of their similarity, so similar texts share one all but surely, and texts that
have little in common meet in no task: the work grows with the texts, not with their pairs. What is linked is only a candidate: shingle sets of a group's texts are compared exactly before one goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_ROWS, digest_of, sized, without_rows, written
from threadloom.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
#: Near copies: words of a shingle, the least similarity, and the bits of a fingerprint.
COPY_WORDS, COPY_SIMILARITY, COPY_BITS = 5, 0.8, 128
#: A group whose texts have so many shingles together is compared in one task.
GROUP_SHINGLES = 1 << 20
#: Keys of a text, and the least hashes that a key is made of: texts with a similarity of 0.8 share none with a chance of (1 - 0.8 ** 3) ** 20, one in 1.7 million.
COPY_BANDS, COPY_BAND_HASHES = 20, 3
#: Texts of one key that are compared all at once with those of other keys; more go by pivots.
RUN_ROWS = 16
#: Blocks of these are made so small that there are so many, down to so many fingerprints.
COPY_BLOCKS, COPY_BLOCK_ROWS = 8, 4096
#: Fingerprints of one side of a comparison task (8 bytes each).
STRATUM_ROWS = 262_144
#: From so many pairs on, a tile is compared by its smaller tiles.
LARGE_PAIRS = 1 << 20
_BLOCK = 1 << 16
#: Fingerprints of a tile's sides where near copies are compared; its buffers stay in the processor's cache.
_TILE_ROWS, _TILE_COLUMNS = 64, 4096


def _majority(text: str | None, words_per_shingle: int, hashes: Callable[[list[bytes]], np.ndarray], size: int) -> np.ndarray:
    """``size`` bytes: of each bit whether it is set in over half of the shingles' hashes; zero where there are no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(size, np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    stops = ends[k - 1 :].tolist()
    ones = np.zeros(8 * size, np.int64)
    for a in range(0, len(starts), _BLOCK):
        part = hashes([joined[i:j] for i, j in zip(starts[a : a + _BLOCK], stops[a : a + _BLOCK], strict=True)])
        ones += np.unpackbits(part.reshape(-1, size), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(starts), bitorder="little")


def _xxh64(shingles: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], "<u8").view(np.uint8)


def _xxh128(shingles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, SEED) for x in shingles]), np.uint8)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one whole text; 0 where it has no words or is null."""
    return int(_majority(text, words_per_shingle, _xxh64, 8).view("<u8")[0])


def wide_fingerprint(text: str | None, words_per_shingle: int = COPY_WORDS) -> bytes:
    """128-bit SimHash of one whole text; zero bytes where it has no words or is null."""
    return _majority(text, words_per_shingle, _xxh128, COPY_BITS // 8).tobytes()


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, seed) | 1 for i in range(n)], np.uint64)


_FACTORS, _ADDENDS, _BAND_STARTS = _odd(COPY_BANDS * COPY_BAND_HASHES, 1), _odd(COPY_BANDS * COPY_BAND_HASHES, 2), _odd(COPY_BANDS, 3)


def _mixed(x: np.ndarray, addend: int) -> np.ndarray:
    """Numbers that differ in all bits where ``x`` differs in any."""
    x = x + np.uint64(addend)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _shingle_numbers(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, which are made of the hashes of their words; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = max(0, len(words) - words_per_shingle) + 1 if words else 0
    made = each[:n].copy()
    for k in range(1, min(words_per_shingle, len(words))):
        made = made * _FACTORS[0] + each[k : k + n]
    return np.unique(_mixed(made, SEED))


def copy_sketch(text: str | None, words_per_shingle: int = COPY_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of the set of a text's shingles: the 128-bit SimHash as two words, and the keys that similar sets share. Without words zero, and no keys."""
    shingles = _shingle_numbers(text, words_per_shingle)
    if not shingles.size:
        return np.zeros(2, np.uint64), np.zeros(0, np.uint64)
    ones = np.zeros(COPY_BITS, np.int64)
    bits = np.stack([shingles, _mixed(shingles, 1)], axis=1).view(np.uint8)
    for a in range(0, shingles.size, 255):  # as many as a byte counts
        ones += np.add.reduce(np.unpackbits(bits[a : a + 255], axis=1), axis=0, dtype=np.uint8)
    least = np.full(_FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, shingles.size, 4096):
        values = np.multiply.outer(_FACTORS, shingles[a : a + 4096])
        values += _ADDENDS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    keys = _BAND_STARTS  # a key of one band is none of another
    for k in range(COPY_BAND_HASHES):
        keys = _mixed(keys ^ least[k::COPY_BAND_HASHES], 0)
    return np.packbits(ones * 2 > shingles.size).view("<u8"), keys


def set_radius(similarity: float, bits: int = COPY_BITS) -> int:
    """Bits that fingerprints of sets with this Jaccard similarity differ by at most, but for one pair in some hundred thousand: the mean and five deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def radius_of(similarity: float, bits: int = COPY_BITS) -> int:
    """The most bits that fingerprints of texts with this cosine similarity differ by, on average."""
    return int(bits * math.acos(similarity) / math.pi)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS, digests: bool = False
) -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the 64 bits as a signed long. ``digests`` adds the digest of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words_per_shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    more = [digest_of(text_col).alias("digest")] if digests else []
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return own.mapInArrow(work, "doc_id long, fp long" + ", digest binary" * digests)


class _Forest:
    """Union-find over positions, joined a batch of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            over = self.parent[up]
            if np.array_equal(over, up):
                self.parent[x] = up
                return up
            up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            self.parent[np.maximum(a, b)] = np.minimum(a, b)  # of several claims on a root one wins; the others come again


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of many runs, one after another."""
    if not starts.size:
        return starts
    shift = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return shift + np.arange(shift.size)


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        differ = c[1:] != c[:-1]
        new[1:] |= differ.any(axis=1) if differ.ndim > 1 else differ
    return np.r_[np.flatnonzero(new), n]


def _each_link(values: np.ndarray, side: np.ndarray | None, radius: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls ``found`` with the places of all pairs within the radius, a batch at a time: pairs of different sides, or any without sides.

    Tiles hold fingerprints with equal population counts in each 16-bit word. Inside large tiles, smaller ones with equal
    counts in each byte are told apart in the same way.
    """
    two = side is not None
    side = side if two else np.zeros(values.size, np.int8)
    in_bytes = np.bitwise_count(values.view(np.uint8).reshape(-1, 8)).astype(np.int8)
    in_words = in_bytes[:, ::2] + in_bytes[:, 1::2]
    order = np.lexsort((*in_bytes.T, *in_words.T, side))
    values, in_bytes, in_words, side = values[order], in_bytes[order], in_words[order], side[order]
    tile = _bounds(in_words, side)
    small = _bounds(in_bytes, side)
    small_of_tile = np.searchsorted(small, tile)  # every tile begins with a small one
    tile_counts, tile_side = in_words[tile[:-1]].astype(np.int16), side[tile[:-1]]
    small_counts, small_sizes = in_bytes[small[:-1]], np.diff(small)

    def compare(a: int, b: int, at: np.ndarray) -> None:
        for i0 in range(a, b, 256):
            rows = values[i0 : min(i0 + 256, b)]
            for j0 in range(0, at.size, 8192):
                some = at[j0 : j0 + 8192]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ values[some][None, :]) <= radius)
                if i.size:
                    found(order[i + i0], order[some[j]])

    for t in range(tile.size - 1):
        if two and tile_side[t]:
            break
        others = np.flatnonzero(tile_side == 1) if two else np.arange(t, tile.size - 1)
        near = others[np.abs(tile_counts[others] - tile_counts[t]).sum(axis=1) <= radius]
        if not near.size:
            continue
        pairs = int(tile[t + 1] - tile[t]) * int((tile[near + 1] - tile[near]).sum())
        if pairs < LARGE_PAIRS:
            compare(int(tile[t]), int(tile[t + 1]), _runs(tile[near], tile[near + 1] - tile[near]))
            continue
        subs = _runs(small_of_tile[near], small_of_tile[near + 1] - small_of_tile[near])
        counts = np.ascontiguousarray(small_counts[subs].T)
        for s in range(small_of_tile[t], small_of_tile[t + 1]):
            apart = np.zeros(subs.size, np.int8)
            for k in range(8):
                apart += np.abs(counts[k] - small_counts[s, k])
            close = subs[apart <= radius]
            compare(int(small[s]), int(small[s + 1]), _runs(small[close], small_sizes[close]))


def _sides(left: int, right: int | None) -> np.ndarray | None:
    return None if right is None else np.repeat(np.array([0, 1], np.int8), (left, right))


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links between two sets of fingerprints, or within one."""
    values = left if right is None else np.concatenate([left, right])
    forest = _Forest(values.size)
    if values.size:
        _each_link(values, _sides(left.size, None if right is None else right.size), radius, forest.join)
    every = np.arange(values.size)
    root = forest.roots(every)
    moved = root != every
    return values[moved], values[root[moved]]


def _each_wide_link(values: np.ndarray, side: np.ndarray | None, radius: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """What ``_each_link`` does, for a radius that few pairs of small tiles exceed: tiles are runs in order of population counts, of the
    same size each, and those whose counts are further apart than the radius are skipped."""
    counts = np.bitwise_count(values)
    left = np.arange(values.size) if side is None else np.flatnonzero(side == 0)
    right = left if side is None else np.flatnonzero(side == 1)
    left, right = left[np.argsort(counts[left], kind="stable")], right[np.argsort(counts[right], kind="stable")]
    ours, theirs, ordered = values[left], values[right], counts[right].astype(np.int16)
    apart, bits = np.empty((_TILE_ROWS, _TILE_COLUMNS), np.uint64), np.empty((_TILE_ROWS, _TILE_COLUMNS), np.uint8)
    for i0 in range(0, left.size, _TILE_ROWS):
        rows = ours[i0 : i0 + _TILE_ROWS]
        low, high = int(counts[left[i0]]), int(counts[left[i0 + rows.size - 1]])
        begin, end = (int(np.searchsorted(ordered, c, s)) for c, s in ((low - radius, "left"), (high + radius, "right")))
        for j0 in range(max(begin, i0) if side is None else begin, end, _TILE_COLUMNS):
            columns = theirs[j0 : min(j0 + _TILE_COLUMNS, end)]
            x, n = apart[: rows.size, : columns.size], bits[: rows.size, : columns.size]
            np.bitwise_xor(rows[:, None], columns[None, :], out=x)
            np.bitwise_count(x, out=n)
            if n.min() <= radius:
                i, j = np.nonzero(n <= radius)
                found(left[i + i0], right[j + j0])


def linked_wide(halves: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, root) of a spanning forest of the links within the radius; a row of ``halves`` is a fingerprint of two words."""
    forest = _Forest(len(halves))

    def found(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(halves[i] ^ halves[j]).sum(axis=1, dtype=np.int64) <= radius
        near &= i != j
        if near.any():
            forest.join(i[near], j[near])

    if len(halves):
        for k in (0, 1):  # of two halves one differs by half of the radius at most
            _each_wide_link(np.ascontiguousarray(halves[:, k]), side, radius // 2, found)
    every = np.arange(len(halves))
    root = forest.roots(every)
    return every[root != every], root[root != every]


def linked_by_pivots(halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of links within the radius that keep every component, for texts that are likely to be copies of each other.

    All that is near a text forms a cluster with it, whose texts needn't be compared with each other. As long as clusters are large they are
    taken off; they and what is left are then compared by tiles.
    """
    left, clusters, u, v = np.arange(len(halves)), [], [], []
    while left.size:
        near = np.bitwise_count(halves[left] ^ halves[left[0]]).sum(axis=1, dtype=np.int64) <= radius
        if near.sum() * RUN_ROWS < left.size:
            break
        clusters.append(left[near])
        u.append(clusters[-1][1:])
        v.append(np.full(clusters[-1].size - 1, left[0]))
        left = left[~near]
    if left.size:
        i, j = linked_wide(halves[left], None, radius)
        u.append(left[i])
        v.append(left[j])
    rest = [*clusters, left]
    for k, ours in enumerate(clusters):
        theirs = np.concatenate(rest[k + 1 :])
        i, j = linked_wide(halves[np.r_[ours, theirs]], _sides(ours.size, theirs.size), radius)
        both = np.r_[ours, theirs]
        u.append(both[i])
        v.append(both[j])
    return np.concatenate([*u, left[:0]]), np.concatenate([*v, left[:0]])


def key_links(keys: np.ndarray, halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of links within the radius among fingerprints of equal keys, in order of ``keys``, that keep every component of a key."""
    if not keys.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = _bounds(keys)
    sizes = np.diff(bounds)
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= RUN_ROWS), sizes))
    u, v = [few[:0]], [few[:0]]
    for k in range(1, RUN_ROWS):
        i, j = few[:-k], few[k:]
        same = keys[i] == keys[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        near = np.bitwise_count(halves[i] ^ halves[j]).sum(axis=1, dtype=np.int64) <= radius
        u.append(i[near])
        v.append(j[near])
    for r in np.flatnonzero(sizes > RUN_ROWS):
        i, j = linked_by_pivots(halves[bounds[r] : bounds[r + 1]], radius)
        u.append(i + bounds[r])
        v.append(j + bounds[r])
    return np.concatenate(u), np.concatenate(v)


def copy_candidates(sketches: DataFrame, radius: int) -> DataFrame:
    """(u, v): links among the fingerprints ``sketches(low, high, keys)`` within ``radius`` bits that share a key; they keep every component. u and v are the 16 bytes.

    A key is a row of 24 bytes. Rows of a key come together in one task, which goes through them in order and holds the rows of one key and a batch.
    """
    rows = sketches.select(F.explode("keys").alias("key"), "low", "high").repartition("key").sortWithinPartitions("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, halves: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = key_links(keys, halves, radius)
            ends = np.unique(np.concatenate([halves[i], halves[j]], axis=1), axis=0)
            ends = ends[(ends[:, :2] != ends[:, 2:]).any(axis=1)]
            if len(ends):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ends[:, k : k + 2]], pa.binary()) for k in (0, 2)], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows, which the next batch may go on with
        for batch in batches:
            keys, low, high = (batch.column(k).to_numpy() for k in range(3))
            if not keys.size:
                continue
            halves = np.stack([low, high], axis=1).view(np.uint64)
            end = int(np.searchsorted(keys, keys[-1]))  # where the batch's last key begins
            if held and (end or held[0][0][0] != keys[0]):
                first = int(np.searchsorted(keys, held[0][0][0], "right")) if held[0][0][0] == keys[0] else 0
                held.append((keys[:first], halves[:first]))
                yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield from links(keys[first:end], halves[first:end])
                held = []
            elif not held:
                yield from links(keys[:end], halves[:end])
            held.append((keys[end:], halves[end:]))
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(work, "u binary, v binary")


def near_links(nodes: DataFrame, radius: int = RADIUS, stratum_rows: int = STRATUM_ROWS) -> DataFrame:
    """(u, v): links among distinct fingerprints ``nodes(fp)`` that keep every component within ``radius`` bits.

    The driver sees 65 counts. A stratum of more than ``stratum_rows`` is cut by hash, so a task holds two
    bounded blocks; each block goes to the tasks of the strata it can reach and to no others, which rows work out for themselves.
    """
    sizes = {r["pc"]: r["n"] for r in nodes.groupBy(F.bit_count("fp").alias("pc")).agg(F.count("*").alias("n")).collect()}
    spark = nodes.sparkSession
    if not sizes:
        return spark.createDataFrame([], "u long, v long")
    cuts = {pc: -(-n // stratum_rows) for pc, n in sizes.items()}
    # a block's number is the blocks of smaller strata and its cut; the blocks that a stratum can reach are one range on either side
    first, done = {}, 0
    for pc in sorted(cuts):
        first[pc] = done
        done += cuts[pc]
    near = {pc: [x for x in cuts if abs(x - pc) <= radius] for pc in cuts}
    strata = spark.createDataFrame(
        [(pc, cuts[pc], first[pc], first[min(near[pc])], first[max(near[pc])] + cuts[max(near[pc])] - 1) for pc in cuts],
        "pc int, cuts int, first int, low int, high int",
    )
    own = (
        nodes.select("fp", F.bit_count("fp").alias("pc"))
        .join(F.broadcast(strata), "pc")
        .withColumn("block", F.col("first") + F.expr("cast(pmod(xxhash64(fp), cuts) as int)"))
    )
    other = F.explode(F.sequence("low", "high")).alias("other")
    dealt = own.select("fp", "block", other).select(
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") != F.least("block", "other")).cast("int").alias("side"), "fp"
    )

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        values = part.column("fp").combine_chunks().to_numpy().view(np.uint64)
        side = part.column("side").combine_chunks().to_numpy()
        u, v = linked(values, None, radius) if i == j else linked(values[side == 0], values[side == 1], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("i", "j").applyInArrow(compare, "u long, v long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that can be reached over links,
    the document itself included. Null and word-less texts have fingerprint zero and link like any other;
    a text of fewer words than a shingle is one shingle. Rows with a null doc_id get their component from
    the others; a component of null ids only has a null id. Repeated rows give repeated rows. An empty
    table gives an empty result; further columns of the input are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    by_print = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = connected_components(near_links(by_print.select("fp"), radius), "u", "v", "simhash-links")
    placed = by_print.join(roots, by_print.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    known = placed.join(lows, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copy_links(nodes: DataFrame, radius: int, block_rows: int = STRATUM_ROWS) -> DataFrame:
    """(u, v): links among distinct fingerprints ``nodes(fp)`` of 16 bytes that keep every component within ``radius`` bits.

    Fingerprints form blocks by hash, of ``block_rows`` at most and fewer where there are few; each pair of blocks is a task.
    All pairs are compared, so this is for small tables; ``copy_candidates`` finds those of similar texts.
    """
    n = nodes.count()
    cuts = max(-(-n // block_rows), min(COPY_BLOCKS, -(-n // COPY_BLOCK_ROWS)))
    if not n:
        return nodes.sparkSession.createDataFrame([], "u binary, v binary")
    own = nodes.select("fp", F.expr(f"cast(pmod(xxhash64(fp), {cuts}) as int)").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("other")
    dealt = own.select("fp", "block", other).select(
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") != F.least("block", "other")).cast("int").alias("side"), "fp"
    )

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        found = part.column("fp").to_pylist()
        halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        side = part.column("side").combine_chunks().to_numpy()
        order = np.argsort(side, kind="stable")
        u, v = linked_wide(halves[order], None if i == j else side[order].astype(np.int8), radius)
        pick = lambda at: pa.array([found[k] for k in order[at].tolist()], pa.binary())
        return pa.table({"u": pick(u), "v": pick(v)})

    return dealt.groupBy("i", "j").applyInArrow(compare, "u binary, v binary")


def copy_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = COPY_WORDS) -> DataFrame:
    """(doc_id, fp, digest, low, high, keys): one row per input row; fp holds the 16 bytes, low and high as well, digest tells the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [copy_sketch(x.as_py(), words_per_shingle) for x in batch.column(1)]
            low, high = (pa.array(np.array([x[k] for x, _ in found], np.uint64).view(np.int64)) for k in (0, 1))
            made = [batch.column(0), pa.array([x.tobytes() for x, _ in found], pa.binary()), batch.column(2), low, high, pa.array([k.view(np.int64) for _, k in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "fp", "digest", "low", "high", "keys"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest_of(text_col).alias("digest"))
    return own.mapInArrow(work, "doc_id long, fp binary, digest binary, low long, high long, keys array<long>")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``, as ``one_of_each`` picks it. All columns stay."""
    prints = written(fingerprints(docs, id_col, text_col, words_per_shingle, digests=True), "simhash")
    nodes = written(prints.select("fp").distinct(), "simhash-distinct")
    roots = connected_components(near_links(nodes, radius), "u", "v", "simhash-links")
    return one_of_each(docs, id_col, text_col, _rooted(prints, roots))


def shingle_sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """``docs(text, ...)`` with ``shingles``, the hashes of the text's distinct shingles in order, in the text's place. A text of fewer words is one shingle."""
    names = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("text"):
                words = x.as_py().encode("utf-8", "surrogatepass").lower().split()
                k = min(words_per_shingle, len(words)) or 1
                each = [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]
                found.append(np.unique(np.array(each, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], [*names, "shingles"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.drop("text").schema) + ", shingles array<long>"
    return docs.select(*names, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, kind)


def _distinct_in_groups(sets: DataFrame, similarity: float, most_shingles: int) -> DataFrame:
    """(digest) of the texts that stay, of ``sets(root, first, digest, shingles)``: in each group, in the order of ``first`` and digest, a text stays
    unless one that stays before it has this Jaccard similarity to it or more.

    Groups of up to ``most_shingles`` are told in a task each. Of larger ones all texts are compared with the first one, in joins; it stays, those that are
    similar go, and the others are groups again. So no two texts of a group that stay are similar, and none goes but by one that stays.
    """

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by([("none", "ascending"), ("id", "ascending"), ("digest", "ascending")])
        stays: list[tuple[bytes, np.ndarray]] = []
        offsets = part.column("shingles").combine_chunks()
        for i, digest in enumerate(part.column("digest").to_pylist()):
            mine = offsets[i].values.to_numpy()
            for other, theirs in stays:
                least, most = sorted((mine.size, theirs.size))
                if other == digest or not most or least >= similarity * most and _jaccard(mine, theirs) >= similarity:
                    break
            else:
                stays.append((digest, mine))
        return pa.table({"digest": pa.array([d for d, _ in stays], pa.binary())})

    order = F.struct("first", "digest")
    kept = []
    while True:
        sizes = sets.groupBy("root").agg(F.sum(F.size("shingles")).alias("n"), F.min(order).alias("head"), F.count("*").alias("rows"))
        sizes = written(sizes, "similar-sizes")
        small = sets.join(sized(sizes.filter((F.col("n") <= most_shingles) | (F.col("rows") == 1)).select("root"), BROADCAST_ROWS // 4), "root", "left_semi")
        kept.append(small.select("root", "digest", "shingles", "first.none", "first.id").groupBy("root").applyInArrow(work, "digest binary"))
        large = sizes.filter((F.col("n") > most_shingles) & (F.col("rows") > 1)).select("root", F.col("head.digest").alias("head"))
        if large.isEmpty():
            break
        heads = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS // 4 else large, "root").filter("digest = head").select("root", "head", F.col("shingles").alias("theirs")).dropDuplicates(["root"])
        kept.append(large.select(F.col("head").alias("digest")))
        both = sets.join(heads, "root")
        common = F.size(F.array_intersect("shingles", "theirs"))
        alike = F.when(F.size("theirs") + F.size("shingles") == 0, 1.0).otherwise(common / (F.size("theirs") + F.size("shingles") - common))
        sets = written(both.filter((F.col("digest") != F.col("head")) & (alike < similarity)).select(*sets.columns), "similar-left")
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (a.size + b.size - common)


def drop_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = COPY_WORDS,
    similarity: float = COPY_SIMILARITY,
    most_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """``docs`` without near copies: texts whose sets of shingles have this Jaccard similarity or more. All columns stay.

    Texts may be near copies where they share a key and the fingerprints of their sets differ by no more than those of sets with this similarity do
    (39 bits for 0.8), or are joined by such links. In each such group the sets are compared exactly, and a text goes only
    where it is similar to one that stays and comes before it: rows come in the order of their ids (null last) and of the digests of their texts. Of rows that
    repeat a text, the first stays. Null and empty texts are equal. An empty table gives an empty result.
    """
    prints = written(copy_sketches(docs, id_col, text_col, words_per_shingle), "simhash")
    roots = connected_components(copy_candidates(prints, set_radius(similarity)), "u", "v", "simhash-links")
    rows = _rooted(prints, roots)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    texts = written(rows.groupBy("root", "digest").agg(first, F.count("*").alias("n")), "similar-texts")
    groups = texts.groupBy("root").agg(F.count("*").alias("texts")).filter("texts > 1").select("root")
    alone = texts.join(groups, "root", "left_anti").select("digest")
    asked = written(texts.join(groups, "root", "left_semi"), "similar-asked")
    own = docs.select(F.col(id_col).cast("long").alias("id"), digest_of(text_col).alias("of"), F.col(text_col).cast("string").alias("text"))
    same = own["id"].eqNullSafe(F.col("first.id")) & (F.col("of") == F.col("digest"))
    sets = shingle_sets(own.join(sized(asked, BROADCAST_ROWS // 8), same).select("root", "first", "digest", "text"), words_per_shingle)
    stays = written(_distinct_in_groups(written(sets, "similar-sets"), similarity, most_shingles).unionByName(alone).distinct(), "similar-stays")
    keeps = texts.join(stays, "digest", "left_semi").select(F.col("first.id").alias("keep_id"), F.col("digest").alias("keep_digest"))
    told = rows.join(keeps, F.col("digest") == F.col("keep_digest"), "left")
    told = told.select("doc_id", "digest", (F.col("keep_digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"))
    return _staying(docs, id_col, text_col, written(told, "simhash-told"))


def _rooted(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, digest, root) of every row; fingerprints without a link are groups of their own."""
    known = sized(written(roots, "simhash-roots"), BROADCAST_ROWS // 4)
    return prints.join(known, F.col("fp") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """``docs`` with one row of each group that ``rows(doc_id, digest, root)`` tells: the one with the smallest id.

    Rows with a null id stay only where their whole group has none. Of rows of a group that share the smallest id the one with
    the smallest digest of its text stays, of rows that repeat both any one. Null and empty texts are a group, of one row with the
    others of fingerprint zero. An empty table gives an empty result.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest"))
    keeps = rows.groupBy("root").agg(first.alias("k"), F.count("*").alias("n")).select(
        F.col("root").alias("of"), F.col("k.id").alias("keep_id"), F.col("k.digest").alias("keep_digest")
    )
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    return _staying(docs, id_col, text_col, written(rows.join(keeps, F.col("root") == F.col("of")).select("doc_id", "digest", own.alias("stays")), "simhash-told"))


def _staying(docs: DataFrame, id_col: str, text_col: str, told: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``told(doc_id, digest, stays)`` that don't stay, and with one of those that repeat a row that does."""
    left = without_rows(docs, id_col, text_col, told.filter("not stays"))
    kept = told.filter("stays").agg(F.count("*").alias("n"), F.count_distinct("digest", F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()).alias("d")).first()
    if kept["n"] == kept["d"]:
        return left
    return left.withColumn("__digest", digest_of(text_col)).dropDuplicates([id_col, "__digest"]).drop("__digest")
