"""Resharding by minimum-cost flow over blocks of a corpus.

A text has its home in the old shard that holds most of its bytes, and texts of one home form blocks by a hash, so equal texts lie
together; a text whose copies fill more than a few blocks is a block of its own, and only one that is larger than a shard is cut by id. Blocks
are few and bounded whatever the corpus holds; from what they hold of each old shard the driver solves a flow to the new capacities
that moves the fewest bytes, and evens out what whole blocks leave. Only shards that gave or got rows are rewritten.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.llm.common import sized, written

BLOCKS_PER_SHARD = 1024
#: A text whose rows are larger than so many average blocks is a block of its own, numbered in pieces of a 64th of a shard's share.
HOT_BLOCKS, CUT_INTO = 8, 64
#: Shards are even when the fullest and the emptiest differ by this part of a share.
CLOSE = 0.002
#: Where bytes lie that are in none of the new shards.
ELSEWHERE = -1
#: Rows of a file that ``rewrite_affected`` writes.
FILE_ROWS = 1_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (i, j) -> amount that carries all supply within the capacities at the least total of cost(i, j) an amount.

    Every supply begins where it costs least. While a place holds too much, the cheapest chain of changes leads from such a place to one
    with room (successive shortest paths): a step from a to b costs what the cheapest supply at a costs more at b. The graph of
    these steps has a node a place, so the work for a chain doesn't depend on the number of supplies.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the supply is larger than the capacities")
    if not n:
        return {}
    price = np.array([[cost(i, j) for j in range(m)] for i in range(n)], float)
    start = price.argmin(axis=1).tolist()
    flow: list[dict[int, int]] = [{j: s} if s else {} for j, s in zip(start, supply, strict=True)]
    spare = list(capacity)
    for j, s in zip(start, supply, strict=True):
        spare[j] -= s
    steps: list[list[list[tuple[float, int]]]] = []
    for a in range(m):
        own = [i for i in range(n) if flow[i] and start[i] == a]
        more = price[own] - price[own, a][:, None]
        steps.append([sorted(zip(more[:, b].tolist(), own, strict=True)) for b in range(m)])
    dear = np.full((m, m), np.inf)
    changed = set(range(m))
    while min(spare) < 0:
        for a in changed:
            for b in range(m):
                if a != b:
                    heap = steps[a][b]
                    while heap and not flow[heap[0][1]].get(a):
                        heappop(heap)
                    dear[a, b] = heap[0][0] if heap else np.inf
        far = np.where(np.array(spare) < 0, 0.0, np.inf)
        via = np.full(m, -1)
        for _ in range(m):
            through = far[:, None] + dear
            least = through.min(axis=0)
            nearer = least < far - 1e-12
            if not nearer.any():
                break
            via[nearer] = through.argmin(axis=0)[nearer]
            far = np.where(nearer, least, far)
        b = int(np.where(np.array(spare) > 0, far, np.inf).argmin())
        path = []
        end = b
        while via[b] >= 0:
            a = int(via[b])
            path.append((a, b, steps[a][b][0][1]))
            b = a
        amount = min(-spare[b], spare[end], *(flow[i][a] for a, _, i in path))
        spare[b] += amount
        spare[end] -= amount
        changed = {b}
        for a, to, i in path:
            flow[i][a] -= amount
            if not flow[i][a]:
                del flow[i][a]
            if to not in flow[i]:
                flow[i][to] = 0
                for c in range(m):
                    if c != to:
                        heappush(steps[to][c], (float(price[i, c] - price[i, to]), i))
            flow[i][to] += amount
            changed |= {a, to}
    return {(i, j): amount for i, x in enumerate(flow) for j, amount in x.items()}


@dataclass(frozen=True)
class Block:
    """What moves as a whole. ``lies``: new shard -> bytes that lie there already; without it all of them lie in ``old``."""

    key: tuple
    old: int
    size: int
    rows: int = 0
    lies: dict[int, int] | None = None

    def moved(self, shard: int) -> int:
        """Bytes that move if the block goes to that shard."""
        return self.size - (self.lies.get(shard, 0) if self.lies is not None else self.size * (self.old == shard))


@dataclass(frozen=True)
class Plan:
    """New shard of each block, the bytes that move, and the fewest that could if blocks could be cut."""

    placed: dict[tuple, int]
    moved: int
    least: float


def _even_out(held: list[dict[tuple, Block]], over: list[float], close: float, rounds: int) -> None:
    """Move or swap blocks between the shards that are most over and under their capacities until these are close.

    Of the changes that halve the gap at least the one that moves the fewest further bytes is taken, else the one that leaves the smallest gap.
    """
    for _ in range(rounds):
        a = max(range(len(held)), key=over.__getitem__)
        b = min(range(len(held)), key=over.__getitem__)
        gap = over[a] - over[b]
        if gap <= max(1.0, close):
            return
        theirs = sorted(held[b].values(), key=lambda x: (x.size, x.key))
        sizes = [x.size for x in theirs]
        best: tuple | None = None
        for x in held[a].values():
            at = bisect_left(sizes, x.size - gap / 2)
            for y in (None, *theirs[max(0, at - 1) : at + 1]):
                after = abs(gap - 2 * (x.size - (y.size if y else 0)))
                if after < gap:
                    further = x.moved(b) - x.moved(a) + (y.moved(a) - y.moved(b) if y else 0)
                    rank = (0, further, after) if after <= gap / 2 else (1, after, further)
                    if best is None or rank < best[0]:
                        best = (rank, x, y)
        if best is None:
            return
        for block, frm, dest in ((best[1], a, b), (best[2], b, a)):
            if block is not None:
                held[dest][block.key] = held[frm].pop(block.key)
                over[frm] -= block.size
                over[dest] += block.size


def plan_report(blocks: list[Block], shards: int, weights: list[float] | None = None, rounds: int = 2000) -> Plan:
    """Where blocks go so that shards fill their capacities and the fewest bytes move. ``weights``: relative capacities (equal without).

    The flow is over blocks and new shards, and what a block costs in a shard are its bytes that don't lie there. The few blocks
    that it cuts go where most of them went; then blocks are moved or swapped until shards differ by CLOSE of a share at most.
    """
    total = sum(b.size for b in blocks)
    weights = weights or [1.0] * shards
    marks = [round(total * sum(weights[: j + 1]) / sum(weights)) for j in range(shards)]
    capacity = [b - a for a, b in zip([0, *marks], marks)]
    ordered = sorted(blocks, key=lambda b: (-b.size, b.key))
    flow = min_cost_flow([b.size for b in ordered], capacity, lambda i, j: ordered[i].moved(j) / max(1, ordered[i].size))
    most: dict[int, tuple[int, int]] = {}
    least = 0.0
    for (i, j), amount in flow.items():
        least += amount * ordered[i].moved(j) / max(1, ordered[i].size)
        most[i] = max(most.get(i, (-1, 0)), (amount, -j))
    held: list[dict[tuple, Block]] = [{} for _ in range(shards)]
    for i, b in enumerate(ordered):
        held[-most[i][1] if i in most else 0][b.key] = b
    over = [sum(b.size for b in x.values()) - c for x, c in zip(held, capacity, strict=True)]
    _even_out(held, over, CLOSE * total / shards, rounds)
    return Plan({key: j for j, x in enumerate(held) for key in x}, sum(b.moved(j) for j, x in enumerate(held) for b in x.values()), least)


def plan_transfers(blocks: list[Block], shards: int, weights: list[float] | None = None, rounds: int = 2000) -> dict[tuple, int]:
    """New shard of each block: the places of ``plan_report``."""
    return plan_report(blocks, shards, weights, rounds).placed


def file_layout(docs: DataFrame) -> DataFrame:
    """``docs`` with the column __old_shard: the number of the file that a row lies in, files in order of their names.

    Rows that come from no file form one shard. The names are as many as files, so one task can number them.
    """
    named = docs.withColumn("__file", F.coalesce(F.input_file_name(), F.lit("")))
    numbers = named.select("__file").distinct().withColumn("__old_shard", F.row_number().over(Window.orderBy("__file")) - 1)
    return named.join(sized(written(numbers, "files")), "__file").drop("__file")


def reshard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks_per_shard: int = BLOCKS_PER_SHARD,
    old_col: str | None = None,
    together: bool = True,
) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot), one row per input row.

    ``old_col`` holds the number of the shard that a row lies in now; without it rows lie where a hash of their text
    says. A null counts as 0; rows of numbers that no new shard has move wherever they go. With ``together`` equal texts go to one shard (a
    text that is larger than a shard's share is cut by a hash of ids): the text's home is the old shard with most of its bytes. Blocks are
    formed of texts of one home, so only those move that balance or a copy elsewhere asks for. Without ``together`` each row's home is
    its own old shard. Slots count from 0 in each shard, in order of block and id.
    Null texts have no bytes; null ids come first in their block; repeated rows get slots of their own. An
    empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(text)
    old = F.coalesce(F.col(old_col).cast("int"), F.lit(0)) if old_col else F.pmod(hashed, F.lit(shards)).cast("int")
    base = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hashed.alias("hashed"),
            old.alias("old"),
            F.when(old.between(0, shards - 1), old).otherwise(ELSEWHERE).alias("lies"),
        ),
        "shard-sizes",
    )
    most = F.max(F.struct("size", (-F.col("lies")).alias("lies")))["lies"]
    by_lies = base.groupBy("hashed", "lies").agg(F.sum("size").alias("size"))
    texts = written(by_lies.groupBy("hashed").agg(F.sum("size").alias("size"), (-most).alias("home"), F.count("*").alias("n")), "shard-texts")
    total = texts.agg(F.sum("size").alias("n")).first()["n"] or 0
    n_blocks = shards * blocks_per_shard
    share, hot_size = max(1, total // shards), max(1, total * HOT_BLOCKS // n_blocks)
    # at most n_blocks / HOT_BLOCKS texts: (hash, number of its block, home, pieces, whether they may go to different shards)
    hot = [
        (r["hashed"], n_blocks + n, r["home"], -(-r["size"] * CUT_INTO // share), int(r["size"] > share))
        for n, r in enumerate(texts.filter(F.col("size") > hot_size).orderBy("hashed").collect())
    ]
    marks = spark.createDataFrame(hot, "hashed long, own int, hot_home int, cuts long, apart int")
    fine = base.join(F.broadcast(marks), "hashed", "left")
    if together:
        # homes of texts that lie in several shards; hot ones bring theirs along, and their rows spread over this join by a key of their own
        spread = written(texts.filter((F.col("n") > 1) & (F.col("size") <= hot_size)).select(F.col("hashed").alias("key"), "home"), "shard-homes")
        fine = fine.withColumn("key", F.when(F.col("own").isNull(), F.col("hashed")).otherwise(F.xxhash64("doc_id", "hashed")))
        fine = fine.join(sized(spread), "key", "left").withColumn("home", F.when(F.col("apart") == 1, F.col("lies")).otherwise(F.coalesce("hot_home", "home", "lies")))
    else:
        fine = fine.withColumn("home", F.col("lies"))
    homes = base.select("lies").distinct().count()
    fine = fine.select(
        "doc_id",
        "size",
        "text_crc32",
        "old",
        "lies",
        "home",
        F.coalesce("own", F.pmod(F.xxhash64("hashed"), F.lit(-(-n_blocks // max(1, homes)))).cast("int")).alias("block"),
        F.when(F.col("cuts").isNotNull(), F.expr("pmod(xxhash64(doc_id), cuts)")).otherwise(0).cast("int").alias("cut"),
        F.coalesce("apart", F.lit(0)).alias("apart"),
    )
    # a piece is numbered by one task; a unit is placed as a whole: a block of a home, or a piece of a text that is too large
    by_lies = fine.groupBy("home", "block", "cut", "apart", "lies").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    pieces = by_lies.groupBy("home", "block", "cut", "apart").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lies", "size"))).alias("bytes"))
    stats = pieces.collect()
    units: dict[tuple, Counter] = {}
    for r in stats:
        units.setdefault((r["home"], r["block"], r["cut"] if r["apart"] else 0), Counter()).update(r["bytes"])
    placed = plan_transfers([Block(k, k[0], sum(c.values()), 0, dict(c)) for k, c in units.items()], shards)
    filled, where = [0] * shards, []
    for r in sorted(stats, key=lambda r: (r["home"], r["block"], r["cut"])):
        shard = placed[r["home"], r["block"], r["cut"] if r["apart"] else 0]
        where.append((r["home"], r["block"], r["cut"], shard, filled[shard]))
        filled[shard] += r["n"]
    places = spark.createDataFrame(where, "home int, block int, cut int, shard int, first_slot long")
    at = F.row_number().over(Window.partitionBy("home", "block", "cut").orderBy("doc_id", "size", "text_crc32", "old"))
    return (
        fine.withColumn("at", at)
        .join(sized(places), ["home", "block", "cut"])
        .select("doc_id", "size", "text_crc32", F.col("old").alias("old_shard"), "shard", (F.col("first_slot") + F.col("at") - 1).cast("long").alias("slot"))
    )


def rewrite_affected(
    docs: DataFrame, placed: DataFrame, old_paths: dict[int, str], out: str, id_col: str = "doc_id", text_col: str = "text", file_rows: int = FILE_ROWS
) -> dict[int, str]:
    """Write anew the files of shards that gave or got documents; returns shard -> path, old paths where nothing changed.

    ``placed`` is the result of ``reshard``, ``old_paths`` where each old shard lies. Documents of other
    shards are not written. Rows are told by id, size and checksum, repeated ones by a running number, so every row is written
    once, null ids included. A task writes ``file_rows`` slots of a shard, in their order.
    """
    moved = placed.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = {r["s"] for r in moved.collect()} | {r["shard"] for r in placed.select("shard").distinct().collect() if r["shard"] not in old_paths}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).cast("long").alias("__id"), (F.octet_length(text) + 8).cast("long").alias("__size"), F.crc32(text).alias("__crc")]
    number = F.row_number().over(Window.partitionBy("__id", "__size", "__crc").orderBy("__size"))
    of_slot = F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot")).alias("number")
    rows = docs.select("*", *keys).withColumn("__number", number)
    new = placed.select("doc_id", "size", "text_crc32", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), of_slot).filter(
        F.col("__shard").isin(sorted(affected))
    )
    same = F.col("__id").eqNullSafe(F.col("doc_id_2")) & (F.col("__size") == F.col("size_2")) & (F.col("__crc") == F.col("text_crc32")) & (F.col("__number") == F.col("number"))
    new = new.withColumnsRenamed({"doc_id": "doc_id_2", "size": "size_2"})
    rows = rows.withColumnsRenamed({c: f"__own_{n}" for n, c in enumerate(docs.columns)})
    both = rows.join(new, same).select(*(F.col(f"__own_{n}").alias(c) for n, c in enumerate(docs.columns)), "__shard", "__slot")
    part = F.floor(F.col("__slot") / file_rows)
    both.repartition("__shard", part).sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(out)
    return {**{s: p for s, p in old_paths.items() if s not in affected}, **{s: f"{out}/__shard={s}" for s in affected}}
