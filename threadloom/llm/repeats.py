"""Removal of passages that stand in an earlier document too, by distributed prefix doubling.

A window is a string of ``length`` bytes. Ranking every position of a corpus again and again would shuffle many times its size, so positions are first put
into groups that no match can cross: each window takes the place of its least hash of ``GRAM`` bytes as its anchor, and equal windows have equal
anchors. Neighbouring windows share an anchor, and are one context of a few dozen bytes. A first pass finds the anchors that stand
more than once, a second one their contexts, each with the smallest and largest id that has it.

Where an anchor has one context, all its windows are the same everywhere. Elsewhere prefix doubling tells windows apart: a third pass takes the
bytes of these contexts, partitioned by anchor; within an anchor, Spark sorts the positions by their first bytes and ranks them, then sorts by pairs of the rank of a position and of the one as far on as the ranked string
is long, ranks anew, and so on until the string is the window. Positions that nothing equals drop out at each round. Contexts, with the smallest id of each of their windows, are then
joined to the places where they stand.

Contexts are told apart by two hashes of 64 bits together; of the windows that are ranked, the bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import discard, forget_shuffles, slices, written

LENGTH = 50
#: Bytes that an anchor is chosen by; the first prefix that is ranked is half a window.
GRAM = 32
#: Texts are looked at in runs of at least so many bytes, and longer ones in parts of so many windows.
_RUN, _PART = 1 << 16, 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
#: A filter of shared anchors has 16 bits for each, and no more than these in all (256 MB); what it lets through falls away later.
_MOST_BITS = 1 << 31
_SLAB = 23


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache
def _values() -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C13
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (base, pow(base, -1, 2**64)))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least value of each ``w`` that follow one another."""
    n = 1
    while 2 * n <= w:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[: v.size - (w - n)], v[w - n :]) if n < w else v


def _runs(data: np.ndarray, parts: list[tuple[int, int]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, first, last) of each run of windows of one anchor; ``parts`` are the beginnings and ends of texts in ``data``."""
    up, down = _powers(_RUN + _PART + length)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_values()[data] * down[: data.size], out=sums[1:])
    key = _mixed((sums[gram:] - sums[:-gram]) * up[: data.size - gram + 1])
    place = _least((key & ~_PLACE) | np.arange(key.size, dtype=np.uint64), length - gram + 1) & _PLACE
    ok = np.zeros(place.size, bool)
    for a, b in parts:
        ok[a : max(a, b - length + 1)] = True
    change = np.flatnonzero((place[1:] != place[:-1]) | (ok[1:] != ok[:-1])) + 1
    first, last = np.r_[0, change], np.r_[change - 1, place.size - 1]
    first, last = first[ok[first]], last[ok[first]]
    at = place[first].astype(np.int64)
    whole = (sums[last + length] - sums[first]) * up[first]
    shape = ((last - first) * 4 * length + (at - first)).astype(np.uint64)
    return key[at], _mixed(whole ^ _mixed(shape + np.uint64(1))), first, last


def _anchors(column: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, context, text, first, last, data, where first lies in data) for the runs of a column of binary texts, some texts at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    held: list[tuple[int, int, int]] = []  # text, beginning and end in every
    size = 0

    def told():
        starts = np.array([a for _, a, _ in held])
        sizes = np.array([b - a for _, a, b in held])
        data = np.concatenate([every[a:b] for _, a, b in held])
        begins = np.cumsum(sizes) - sizes
        key, context, first, last = _runs(data, list(zip(begins.tolist(), (begins + sizes).tolist(), strict=True)), length, gram)
        of = np.searchsorted(begins, first, "right") - 1
        text = np.array([t for t, _, _ in held])[of]
        shift = starts[of] - begins[of] - offsets[text]
        return key, context, text, first + shift, last + shift, data, first

    for t in range(len(column)):
        a, b = int(offsets[t]), int(offsets[t + 1])
        while b - a >= length:
            end = min(b, a + _PART + length - 1)  # parts by the place in the text alone
            held.append((t, a, end))
            size += end - a
            if size >= _RUN:
                yield told()
                held, size = [], 0
            if end == b:
                break
            a += _PART
    if held:
        yield told()


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _shared(own: DataFrame, length: int, gram: int) -> DataFrame:
    """(key) of the anchors that stand more than once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [key for key, *_ in _anchors(batch.column(0), length, gram)]
            if found:
                key, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(n, 2).astype(np.int64))], ["key", "n"])

    counted = own.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.filter("n > 1").select("key")


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits that tell which keys may be among these; each task fills some of them."""
    n = keys.count()
    bits = min(_MOST_BITS, 1 << max(16, (16 * n).bit_length()))
    slab = min(_SLAB, bits.bit_length() - 1)

    def work(part: pa.Table) -> pa.Table:
        key = part.column("key").to_numpy().view(np.uint64) & np.uint64(bits - 1)
        found = np.zeros(1 << slab, np.uint8)
        found[(key & np.uint64((1 << slab) - 1)).astype(np.int64)] = 1
        return pa.table({"slab": pa.array([int(key[0]) >> slab], pa.int64()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    by_slab = keys.groupBy(F.expr(f"shiftrightunsigned(key & {bits - 1}, {slab})").alias("s"))
    for row in by_slab.applyInArrow(work, "slab long, bits binary").collect():
        out[row["slab"] << slab - 3 : row["slab"] + 1 << slab - 3] = np.frombuffer(row["bits"], np.uint8)
    return out


def _known(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(bits.size * 8 - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _places(own: DataFrame, sent, length: int, gram: int) -> DataFrame:
    """(key, context, doc_id, mark, first, n): each run of windows whose anchor may be shared, with the text it stands in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for key, context, text, first, last, _, _ in _anchors(batch.column(2), length, gram):
                k = np.flatnonzero(_known(sent.value, key))
                columns = [key[k].view(np.int64), context[k].view(np.int64), ids[text[k]], marks[text[k]], first[k].astype(np.int64), (last - first + 1)[k].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "context", "doc_id", "mark", "first", "n"])

    return own.mapInArrow(work, "key long, context long, doc_id long, mark long, first long, n int")


def _contexts(own: DataFrame, sent, length: int, gram: int, whole: bool) -> DataFrame:
    """(key, context, bytes, least, most): each context once, with the smallest and the largest id that has it, partitioned by key. ``bytes`` are null
    unless they are asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [[np.zeros(0, np.int64)] * 3]
            seen: list[bytes | None] = []
            for key, context, text, first, last, data, at in _anchors(batch.column(1), length, gram):
                k = np.flatnonzero(_known(sent.value, key))
                found.append([key[k].view(np.int64), context[k].view(np.int64), ids[text[k]]])
                text = data.tobytes() if whole else b""
                seen += [text[a:b] for a, b in zip(at[k].tolist(), (at + last - first + length)[k].tolist(), strict=True)] if whole else [None] * k.size
            key, context, of = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((of, context, key))  # each context once, with its first and last id
            key, context, of = key[order], context[order], of[order]
            begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]) if key.size else np.zeros(0, np.int64)
            ends = np.r_[begins[1:], key.size] - 1 if key.size else begins
            texts = pa.array([seen[i] for i in order[begins].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[begins]), pa.array(context[begins]), texts, pa.array(of[begins]), pa.array(of[ends])], ["key", "context", "bytes", "least", "most"])

    found = own.select("doc_id", "text").mapInArrow(work, "key long, context long, bytes binary, least long, most long")
    by = ["key", "context", "bytes"] if whole else ["key", "context"]
    return found.repartition("key").groupBy(*by).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def ranked_windows(contexts: DataFrame, length: int, start: int) -> DataFrame:
    """(key, context, at, low) of ``contexts(key, context, bytes, least)``: for windows of a context that other contexts of smaller ids than its own have too,
    the smallest of these.

    Strings of ``start`` bytes are ranked first, at the places of a window that doubling meets; each round ranks pairs of ranks, of a place and of the place as far on as
    the ranked strings are long, or less at the last round. The rank of equal strings is the first of their rows; a row that nothing equals drops out.
    """
    places, have = [0], start
    while have < length:
        step = min(have, length - have)
        places, have = places + [p + step for p in places], have + step
    rows = contexts.select("key", "context", "least", "bytes", F.explode(F.expr(f"sequence(0, octet_length(bytes) - {length})")).alias("at"))
    strings = {f"s{k}": F.expr(f"substring(bytes, at + {p + 1}, {start})") for k, p in enumerate(places)}
    rows = rows.withColumns(strings).withColumn("row", F.monotonically_increasing_id()).drop("bytes")
    names = [[s] for s in strings]
    while True:
        if len(names) == 1:
            low = rows.withColumn("low", F.min("least").over(Window.partitionBy("key", *names[0])))
            return low.filter("low < least").select("key", "context", "at", "low")
        ranks = []
        for by in names:
            same = Window.partitionBy("key", *by)
            rows = rows.withColumns({"rank": F.min("row").over(same), "same": F.count("*").over(same)}).filter("same > 1").drop("same", *by)
            ranks.append(f"r{len(ranks)}_{len(names)}")
            rows = rows.withColumnRenamed("rank", ranks[-1])
        names = [ranks[k : k + 2] for k in range(0, len(ranks), 2)]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, start: int | None = None) -> DataFrame:
    """(doc_id, mark, runs): for texts (mark is their xxhash64) that hold windows of ``length`` bytes which a document with a smaller id holds
    too, where such windows begin, as runs (a, b) from the first to the last beginning, in no order."""
    spark = docs.sparkSession
    own = _own(docs, id_col, text_col).filter("doc_id is not null")
    gram = min(gram, length)
    keys = written(_shared(own, length, gram), "repeat-keys")
    forget_shuffles(spark)
    by_key = Window.partitionBy("key")
    sent = spark.sparkContext.broadcast(_filter(keys))
    discard(keys)
    contexts = _contexts(own, sent, length, gram, whole=False)
    contexts = contexts.withColumns({"all": F.count("*").over(by_key), "low": F.min("least").over(by_key), "high": F.max("most").over(by_key)}).filter("low < high")
    contexts = written(contexts.select("key", "context", "least", "most", "all"), "repeat-contexts")
    forget_shuffles(spark)
    unlike = spark.sparkContext.broadcast(_filter(contexts.filter("all > 1").select("key").distinct()))
    lows = ranked_windows(_contexts(own, unlike, length, gram, whole=True).select("key", "context", "bytes", "least"), length, start or -(-length // 2))
    lows = lows.groupBy("key", "context").agg(F.collect_list(F.struct("at", "low")).alias("lows"))
    told = contexts.select("key", "context", "least", "most").join(lows, ["key", "context"], "left").filter("least < most or lows is not null")
    told = written(told.drop("most"), "repeat-told")
    discard(contexts)
    forget_shuffles(spark)
    sent = spark.sparkContext.broadcast(_filter(told.select("key").distinct()))
    places = _places(own, sent, length, gram).join(told, ["key", "context"])
    # of the texts that share a context all but the first have every window from it
    whole = F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") - 1).alias("b")))
    some = F.expr("transform(filter(lows, x -> x.low < doc_id), x -> struct(first + x.at as a, first + x.at as b))")
    hits = F.when(F.col("least") < F.col("doc_id"), whole).otherwise(some)
    found = places.select("doc_id", "mark", hits.alias("hits")).filter("size(hits) > 0")
    return found.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("hits")).alias("runs"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, start: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each row: the bytes of a text (null: empty) that a window covers which begins in a document with a
    smaller id too are removed. ``spans`` are the removed runs (start, end), ``kept`` the bytes that stay.

    Windows are judged on the texts as they come, and don't reach over their ends; a text shorter than a window stays whole. Rows with the same id
    don't count against each other, and a null id is neither smaller nor larger than another, so such rows stay whole. Repeated rows
    have the same result. An empty table gives an empty result; further columns aren't read.
    """
    runs = repeated_windows(docs, id_col, text_col, length, gram, start)
    runs = written(runs.withColumnsRenamed({"doc_id": "of", "mark": "of_mark"}), "repeat-runs")
    forget_shuffles(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, kept, sizes = [], [], []
            for text, hit in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                sizes.append(len(data))
                if not hit.is_valid:
                    spans.append([])
                    kept.append(data)
                    continue
                a, b = (hit.values.field(c).to_numpy() for c in ("a", "b"))
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, a, 1)
                np.add.at(depth, b + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    own = _own(docs, id_col, text_col)
    both = own.join(runs, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", "text", "runs")
    return both.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
