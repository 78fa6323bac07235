"""Sequence packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each class of lengths share a sequence. The covering program "fewest sequences whose
configurations hold every piece" is priced by multiplicative weights: a knapsack dynamic program finds the
configurations of most weight, and the classes that these cover lose weight by a factor. After every few knapsacks the program over the
configurations found so far is solved, and its prices are the weights to go on with; the knapsack's value bounds what any solution
needs, so the work ends at a stated gap. The solution is rounded as a whole: its configurations are filled with pieces of their classes,
and the few that are left go by best fit into the room that remains. All of this works on at most ``capacity`` counts, so it is the
same work for any corpus; pieces then find their place by rank within length.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import written

CAPACITY = 2048
END_ID = 0
#: Lengths form at most so many classes of equal mass; each counts as its mean, rounded up.
CLASSES = 128
#: The program is solved when its value is within this share of the bound. A pass solves it over the known configurations and then
#: runs so many knapsacks, each of which gives so many configurations and takes weight by this rate. Passes beyond the last are not made.
GAP, KNAPSACKS, CONFIGURATIONS, RATE, PASSES = 0.002, 4, 8, 0.3, 120
#: Roundings that are tried: (mass of the shortest pieces that is kept for the room that remains, most room of a sequence that stays
#: as the program made it; others are opened again).
ROUNDINGS = ((0.0, None), (0.05, None), (0.1, None), (0.2, None), (0.35, None), (0.5, None), (0.0, 4), (0.0, 2), (0.0, 1), (0.0, 0), (0.05, 2), (0.05, 0), (0.1, 0))

#: So many of the roundings go on with programs for what is left, so many times, while that fills so many sequences.
AGAIN, RESIDUALS, RESIDUAL_MASS = 2, 2, 16


# -- lengths -> configurations ------------------------------------------------------------------------------------


def tables(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(most value within each room up to the capacity, the last item taken there or -1); copies without bound, lengths ascending."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = value[:n] + best[c - lengths[:n]]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], took[c] = got[k], k
    return best, took


def chosen(took: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Index of length -> copies, of the best filling of a room."""
    out: dict[int, int] = {}
    while room > 0:
        k = int(took[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of length -> copies, for the most value within the capacity (copies without bound)."""
    return chosen(tables(value, lengths, capacity)[1], lengths, capacity)


def master(cover: np.ndarray, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(x, prices) of the program: least sum of x with ``cover @ x >= 1`` and x >= 0, by a primal-dual interior-point method.

    Every row of ``cover`` must have an entry above 0.
    """
    rows, columns = cover.shape
    x = np.full(columns, 2 / cover.sum(axis=1).min())
    slack = cover @ x - 1
    price = np.full(rows, 0.5 / cover.sum(axis=0).max())
    reduced = 1 - price @ cover
    for _ in range(60):
        off_rows, off_columns = 1 - cover @ x + slack, 1 - price @ cover - reduced
        mean = (x @ reduced + slack @ price) / (rows + columns)
        if mean * (rows + columns) < tolerance * x.sum():
            break
        normal = (cover * (x / reduced)) @ cover.T
        normal[np.diag_indices(rows)] += slack / price

        def step(target: float, bend_x: np.ndarray | float, bend_s: np.ndarray | float) -> tuple[np.ndarray, ...]:
            for_x, for_s = target - x * reduced - bend_x, target - slack * price - bend_s
            d_price = np.linalg.solve(normal, off_rows - cover @ ((for_x - x * off_columns) / reduced) + for_s / price)
            d_reduced = off_columns - d_price @ cover
            return (for_x - x * d_reduced) / reduced, (for_s - slack * d_price) / price, d_price, d_reduced

        def most(v: np.ndarray, d: np.ndarray) -> float:
            down = d < 0
            return min(1.0, float((-v[down] / d[down]).min())) if down.any() else 1.0

        dx, ds, dp, dr = step(0.0, 0.0, 0.0)
        one, two = min(most(x, dx), most(slack, ds)), min(most(price, dp), most(reduced, dr))
        ahead = ((x + one * dx) @ (reduced + two * dr) + (slack + one * ds) @ (price + two * dp)) / (rows + columns)
        dx, ds, dp, dr = step(mean * (ahead / mean) ** 3, dx * dr, ds * dp)
        one, two = 0.99 * min(most(x, dx), most(slack, ds)), 0.99 * min(most(price, dp), most(reduced, dr))
        x, slack, price, reduced = x + one * dx, slack + one * ds, price + two * dp, reduced + two * dr
    return x, price


@dataclass(frozen=True)
class Program:
    """A solution: ``often[k]`` sequences of ``configurations[k]`` (class -> pieces), ``value`` of them in all.

    ``bound``: the least value, where each piece counts as ``sizes`` of its class; ``sure``: no packing of the pieces themselves needs
    fewer sequences than this.
    """

    sizes: np.ndarray
    width: np.ndarray
    of_class: dict[int, int]
    configurations: list[dict[int, int]]
    often: np.ndarray
    value: float
    bound: float
    sure: float


def classes(need: dict[int, int], most: int) -> np.ndarray:
    """The class of each length in ascending order: all of their own if there are few, else ranges of equal mass."""
    lengths = np.array(sorted(need))
    if len(lengths) <= most:
        return np.arange(len(lengths))
    mass = lengths * np.array([need[n] for n in lengths], float)
    at = np.minimum(((np.cumsum(mass) - mass / 2) / mass.sum() * most).astype(int), most - 1)
    return np.unique(at, return_inverse=True)[1]


def configuration_program(need: dict[int, int], capacity: int, most: int = CLASSES, gap: float = GAP) -> Program:
    """The program solved to the gap, or after PASSES as far as it is."""
    lengths = np.array(sorted(need))
    counts = np.array([need[n] for n in lengths], float)
    number = classes(need, most)
    wants = np.bincount(number, counts)
    sizes = np.ceil(np.bincount(number, counts * lengths) / wants).astype(int)
    ends = np.r_[np.flatnonzero(np.diff(number)), len(lengths) - 1]
    tops, lows = lengths[ends], lengths[np.r_[0, ends[:-1] + 1]]
    known: dict[tuple, np.ndarray] = {}

    def add(config: dict[int, int]) -> None:
        key = tuple(sorted((int(k), n) for k, n in config.items()))
        if key not in known:
            cover = np.zeros(len(wants))
            for k, n in key:
                cover[k] = min(n, wants[k])
            known[key] = cover / wants

    for k, size in enumerate(sizes):
        add({k: capacity // int(size)})
    bound = sure = 0.0
    for _ in range(PASSES):
        cover = np.array(list(known.values())).T
        x, price = master(cover)
        value = x.sum() / min(1.0, (cover @ x).min())
        weight, before = price / price.sum(), len(known)
        for n in range(KNAPSACKS):
            worth = weight / wants
            best, took = tables(worth, sizes, capacity)
            bound = max(bound, 1 / best[capacity])
            if n == 0:
                sure = max(sure, 1 / tables(worth, lows, capacity)[0][capacity])
            use = np.zeros(len(wants))
            for k in np.argsort(-(worth + best[capacity - sizes]), kind="stable")[:CONFIGURATIONS].tolist():
                config = chosen(took, sizes, capacity - int(sizes[k]))
                config[k] = config.get(k, 0) + 1
                add(config)
                for i, copies in config.items():
                    use[i] += copies
            use /= wants
            weight = weight * np.exp(-RATE * use / use.max())
            weight /= weight.sum()
        if value <= bound * (1 + gap) or len(known) == before:
            break
    scale = 1 / min(1.0, (cover @ x).min())
    keys = [dict(k) for k in list(known)[: len(x)]]
    return Program(sizes, tops - lows, dict(zip(lengths.tolist(), number.tolist(), strict=True)), keys, x * scale, float(value), bound, min(sure, bound))


# -- configurations -> sequences ------------------------------------------------------------------------------------

Group = tuple[list[tuple[int, int]], int]


def fill(counts: list[tuple[dict[int, int], int]], program: Program, left: dict[int, int], capacity: int) -> list[Group]:
    """Groups of equal sequences from so many of each configuration; takes their pieces from ``left``.

    Places of a configuration get long and short pieces of their classes in turn. The places of its widest class come last: each takes
    the longest piece of that class or its neighbours that fits there, or none.
    """
    lengths, number = sorted(left), dict(left)
    ranges: dict[int, tuple[int, int]] = {}
    for n, k in program.of_class.items():
        low, high = ranges.get(k, (n, n))
        ranges[k] = min(low, n), max(high, n)

    def take(at: int, n: int) -> tuple[int, int]:
        length = lengths[at]
        got = min(n, number[length])
        number[length] -= got
        if not number[length]:
            del lengths[at]
        return length, got

    groups: list[Group] = []
    for config, n in counts:
        order = sorted(config, key=lambda k: (program.width[k], k))
        parts: list[tuple[tuple[int, ...], int, int]] = [((), capacity, n)]  # lengths so far, room, sequences
        turn = 0
        for k in order:
            last = k == order[-1]
            near = [ranges[x] for x in ((k - 1, k, k + 1) if last else (k,)) if x in ranges]
            low, high = min(x for x, _ in near), max(x for _, x in near)
            for place in range(config[k]):
                turn += 1
                fits = last and place == config[k] - 1
                after: list[tuple[tuple[int, ...], int, int]] = []
                for held, room, todo in sorted(parts, key=lambda t: t[1]) if fits else parts:
                    while todo:
                        if fits or turn % 2:
                            at = bisect_right(lengths, min(room, high if fits else ranges[k][1])) - 1
                        else:
                            at = bisect_left(lengths, ranges[k][0])
                        if not 0 <= at < len(lengths) or not (low if fits else ranges[k][0]) <= lengths[at] <= min(room, high):
                            after.append((held, room, todo))
                            break
                        length, got = take(at, todo)
                        after.append(((*held, length), room - length, got))
                        todo -= got
                parts = after
        groups += [(sorted(Counter(held).items(), reverse=True), n) for held, _, n in parts if held]
    left.clear()
    left.update({n: number[n] for n in lengths})
    return groups


def best_fit(need: dict[int, int], capacity: int, opened: list[Group] | None = None) -> list[Group]:
    """Best fit, longest first, by counts, beginning with some opened sequences: ([(length, copies), ...], sequences) groups."""
    room: dict[int, list[Group]] = {}
    open_rooms = np.zeros(capacity + 1, bool)

    def put(left: int, group: list[tuple[int, int]], n: int) -> None:
        room.setdefault(left, []).append((group, n))
        open_rooms[left] = True

    for group, n in opened or ():
        put(capacity - sum(length * k for length, k in group), group, n)
    for length in sorted(need, reverse=True):
        todo = need[length]
        while todo:
            fits = np.flatnonzero(open_rooms[length:])
            if fits.size:
                left = int(fits[0]) + length
                group, n = room[left].pop()
                if not room[left]:
                    open_rooms[left] = False
            else:
                left, group, n = capacity, [], -(-todo // (capacity // length))
            each = left // length
            full = min(n, todo // each)
            if full:
                put(left - each * length, [*group, (length, each)], full)
            todo -= full * each
            if full < n:
                if todo:
                    put(left - todo * length, [*group, (length, todo)], 1)
                    full, todo = full + 1, 0
                if full < n and group:
                    put(left, group, n - full)
    return [g for groups in room.values() for g in groups]


@dataclass(frozen=True)
class Packing:
    """Groups of equal sequences, how many there are, the fewest that there can be, the program's gap and the share of pieces it placed.

    Whole sequences (pieces of the capacity) are no part of the program and count as placed by it nowhere: ``by_program`` is of shorter ones.
    """

    groups: list[Group]
    sequences: int
    at_least: int
    gap: float
    by_program: float


def rounded(need: dict[int, int], program: Program, capacity: int, kept: float, room: int | None) -> tuple[list[Group], dict[int, int]]:
    """(sequences of the program's configurations, the pieces that are in none), by one of the ROUNDINGS.

    The solution is rounded along its running sum, so that all configurations together are as many as the solution's.
    """
    lengths = sorted(n for n, k in need.items() if k)
    mass = np.cumsum([n * need[n] for n in lengths])
    order = np.argsort(-program.often, kind="stable").tolist()
    counts = np.diff(np.floor(np.r_[0.0, np.cumsum(program.often[order])] + 0.5))
    rest = Counter({n: need[n] for n in lengths[: int(np.searchsorted(mass, kept * mass[-1], "right"))]})
    left = {n: need[n] for n in lengths if n not in rest}
    groups = fill([(program.configurations[k], int(n)) for k, n in zip(order, counts, strict=True) if n], program, left, capacity)
    rest.update(left)
    tight = [g for g in groups if room is None or capacity - sum(n * k for n, k in g[0]) <= room]
    for group, n in groups:
        if room is not None and capacity - sum(length * k for length, k in group) > room:
            rest.update({length: k * n for length, k in group})
    return tight, dict(rest)


def pack_report(need: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Groups of equal sequences that hold exactly the needed pieces, with what is known of how good they are.

    Classes are ranges, so sequences come out with some room. The shortest pieces are kept for it and go there by best fit, with the pieces
    whose place in a configuration was too small and those of sequences that came out with too much room. Where more than the bound
    is used, the best roundings go on: the pieces that they left have a program of their own, and so on. Of all results, and
    best fit alone, the one with fewest sequences wins, then the one of which programs have placed most.
    """
    need = {n: k for n, k in need.items() if k}
    whole = need.pop(capacity, 0)
    tail: list[Group] = [([(capacity, 1)], whole)] if whole else []
    if not need:
        return Packing(tail, whole, whole, 0.0, 1.0)
    program = configuration_program(need, capacity)
    least = max(math.ceil(program.sure - 1e-6), -(-sum(n * k for n, k in need.items()) // capacity))
    tries = []
    for rounding in ROUNDINGS:
        tight, rest = rounded(need, program, capacity, *rounding)
        done = best_fit(rest, capacity, tight)
        tries.append((sum(n for _, n in done), sum(rest.values()), rounding, done))
    tries.sort(key=lambda t: t[:2])
    for n, _, rounding, _ in tries[:AGAIN]:  # what is left has a program of its own, whose classes are finer
        if n <= least:
            break
        tight, rest = rounded(need, program, capacity, *rounding)
        for _ in range(RESIDUALS):
            if sum(length * k for length, k in rest.items()) < RESIDUAL_MASS * capacity:
                break
            inner = configuration_program(rest, capacity)
            options = []
            for again in ROUNDINGS:
                more, left = rounded(rest, inner, capacity, *again)
                done = best_fit(left, capacity, [*tight, *more])
                options.append((sum(k for _, k in done), sum(left.values()), more, left, done))
            count, held, more, left, done = min(options, key=lambda t: t[:2])
            tries.append((count, held, rounding, done))
            if held >= sum(rest.values()):
                break
            tight, rest = [*tight, *more], left
    alone = best_fit(need, capacity)
    tries.append((sum(n for _, n in alone), sum(need.values()), None, alone))
    n, outside, _, groups = min(tries, key=lambda t: t[:2])
    return Packing([*groups, *tail], n + whole, least + whole, program.value / program.bound - 1, 1 - outside / sum(need.values()))


def pack(need: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """The groups of ``pack_report``."""
    return pack_report(need, capacity).groups


@dataclass(frozen=True)
class Places:
    """Where the pieces of one length go: from ``start`` on, ``each`` to a sequence."""

    start: np.ndarray
    each: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray


def places(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[int, Places]:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for group, n in groups:
        offset = 0
        for length, each in group:
            rows.setdefault(length, []).append((used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return {k: Places(*(np.array(x, np.int64) for x in zip(*v, strict=True))) for k, v in rows.items()}


# -- texts -> pieces ------------------------------------------------------------------------------------------------


class Tokens:
    """Ids of the public byte-level vocabulary. The rank file is faster and gives the same ids; texts that its
    matcher can't take (very long runs of white space) go by the tokenizer file."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.fast = self.sure = None

    def __getstate__(self):
        return {"path": self.path, "ranks_path": self.ranks_path, "fast": None, "sure": None}

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
            )
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            if self.sure is None:
                from tokenizers import Tokenizer

                self.sure = Tokenizer.from_file(self.path)
            return self.sure.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokens: Tokens, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids and the end id, cut so that only the first piece may be short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*tokens.ids(text.as_py() or ""), END_ID], "<u4")
                    stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                    start = 0
                    for k, stop in enumerate(stops):
                        out.append((doc, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                        start = stop
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokens: Tokens | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null texts count as empty and give one piece, the end id alone. Repeated rows give pieces of their own. An
    empty table gives an empty result; further columns are not read.

    Ranks within a length are made in two steps over hash buckets, so that a length that a third of all pieces
    have is numbered by many tasks.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokens or Tokens(), capacity, id_col, text_col), "packing-pieces")
    need = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(pack(need, capacity))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, p = np.flatnonzero(length == n), where[int(n)]
                k = np.searchsorted(p.start, rank[own], "right") - 1
                at = rank[own] - p.start[k]
                sequence[own] = p.first_sequence[k] + at // p.each[k]
                offset[own] = p.offset[k] + at % p.each[k] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
