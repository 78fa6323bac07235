"""Benchmark decontamination with suffix arrays over the training documents.

Each shard of documents (a run of about SHARD_WORDS words inside a task) gets a suffix array over its words.
Every suffix of every benchmark item is searched in it by its first window; from each place that is found the match is followed as
far as item and document agree, which gives the longest verbatim matches and where they lie. Words that no
item has are one symbol that matches nothing, and suffixes that meet it too early to hold a window are left
out of the array: they can't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Chain, digest_of, without_rows

WINDOW_WORDS = 10
#: Words of a shard, and bytes of benchmark text that are searched for in one pass.
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_ITEMS = pa.list_(pa.string())
_LONGEST = pa.list_(pa.struct([("item", pa.string()), ("item_from", pa.int64()), ("from", pa.int64()), ("length", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


# -- suffix array over symbols ------------------------------------------------------------------------------------


def run_lengths(symbols: np.ndarray) -> np.ndarray:
    """How many symbols other than 0 follow from each position on."""
    n = len(symbols)
    stop = np.where(symbols == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def suffix_array(symbols: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Positions with at least ``least`` symbols before the next 0, in the order of what follows, ``depth`` symbols deep.

    Prefix doubling: positions are ranked by one symbol, then two, four, ... as pairs of ranks.
    """
    runs = run_lengths(symbols)
    inside = np.flatnonzero(symbols)
    if least > 1 and inside.size:  # whole runs that are long enough
        head = np.r_[True, np.diff(inside) > 1]
        inside = inside[np.repeat(runs[inside[head]], np.diff(np.r_[np.flatnonzero(head), inside.size])) >= least]
    if not inside.size:
        return inside
    rank = np.zeros(len(symbols) + depth + 1, np.int64)
    rank[inside] = symbols[inside]
    k = 1
    while True:
        key = rank[inside] * (int(rank.max()) + 1) + rank[inside + k]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[inside[order]] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        k *= 2
        if k >= depth:
            break
    order = np.argsort(rank[inside], kind="stable")
    found = inside[order]
    return found[runs[found] >= least]


def search(symbols: np.ndarray, array: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) places in the array whose suffix begins with each pattern; all at once."""
    width = patterns.shape[1]
    padded = np.r_[symbols, np.zeros(width, symbols.dtype)]
    inside = np.arange(width) < lengths[:, None]

    def bound(after_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(array), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not open_.size:
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            there = padded[array[mid][:, None] + np.arange(width)]
            differ = (there != patterns[open_]) & inside[open_]
            at = differ.argmax(axis=1)
            some = differ[np.arange(len(open_)), at]
            less = there[np.arange(len(open_)), at] < patterns[open_, at]
            right = np.where(some, less, after_equal)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    return bound(False), bound(True)


# -- benchmark blocks ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Suffixes:
    """The suffixes of a block of items that begin a window: their windows, distinct, and where in which items they stand."""

    symbol: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    places: list[list[tuple[int, int]]]
    items: list[str]
    texts: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Suffixes:
        symbol: dict[bytes, int] = {}
        windows: dict[bytes, list[tuple[int, int]]] = {}
        texts = []
        for number, (_, text) in enumerate(items):
            seen = np.array([symbol.setdefault(w, len(symbol) + 1) for w in words(text)], np.int64)
            texts.append(seen)
            size = min(window, len(seen))
            for a in range(len(seen) - size + 1) if size else []:
                windows.setdefault(seen[a : a + size].tobytes(), []).append((number, a))
        patterns = np.zeros((len(windows), window), np.int64)
        lengths = np.array([len(k) // 8 for k in windows], np.int64)
        for row, key in zip(patterns, windows, strict=True):
            row[: len(key) // 8] = np.frombuffer(key, np.int64)
        return cls(symbol, patterns, lengths, list(windows.values()), [item for item, _ in items], texts)


def shard_matches(symbols: np.ndarray, tests: Suffixes) -> Iterator[tuple[int, np.ndarray]]:
    """(window number, positions where it occurs) for the windows that occur in the shard."""
    if not len(tests.places):
        return
    array = suffix_array(symbols, int(tests.lengths.min()), int(tests.lengths.max()))
    first, last = search(symbols, array, tests.patterns, tests.lengths)
    for k in np.flatnonzero(last > first):
        yield int(k), array[first[k] : last[k]]


def reach(symbols: np.ndarray, at: int, text: np.ndarray, begin: int, known: int) -> int:
    """How many symbols agree from these two places on, of which ``known`` are known to."""
    n = known
    most = min(len(symbols) - at, len(text) - begin)
    while n < most:
        part = min(most - n, 64)
        differ = np.flatnonzero(symbols[at + n : at + n + part] != text[begin + n : begin + n + part])
        if differ.size:
            return n + int(differ[0])
        n += part
    return n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(shard: list[tuple[np.ndarray, list, set, list]], tests: Suffixes) -> None:
    """Adds to each document of a shard the spans, items and longest matches that occur in it."""
    starts = np.cumsum([0, *(len(s) + 1 for s, *_ in shard)])
    symbols = np.zeros(int(starts[-1]), np.int64)
    for a, (s, *_) in zip(starts, shard, strict=False):
        symbols[a : a + len(s)] = s
    for k, positions in shard_matches(symbols, tests):
        doc = np.searchsorted(starts, positions, "right") - 1
        size = int(tests.lengths[k])
        for d, p, place in zip(doc.tolist(), (positions - starts[doc]).tolist(), positions.tolist(), strict=True):
            _, spans, items, longest = shard[d]
            spans.append((p, p + size))
            before = int(symbols[place - 1]) if p else 0  # 0: no word, or one that no item has
            for number, begin in tests.places[k]:
                items.add(tests.items[number])
                text = tests.texts[number]
                if not (begin and before and text[begin - 1] == before):  # else it is inside a longer one
                    longest.append((tests.items[number], begin, p, reach(symbols, place, text, begin, size)))


def _pass(df: DataFrame, tests: Suffixes, last: bool) -> DataFrame:
    more = [f.name for f in df.schema if f.name not in ("doc_id", "text", "n_words", "spans", "items", "longest")]
    kept = [] if last else ["text"]
    schema = "doc_id long, " + ("" if last else "text string, ") + "".join(f"{c} binary, " for c in more) + (
        "n_words long, spans array<struct<a:long,b:long>>, items array<string>, longest array<struct<item:string,item_from:long,`from`:long,length:long>>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tests.symbol.get
        for batch in batches:
            names = batch.schema.names
            begin, size, shard, counts = 0, 0, [], []

            def settle(begin: int, shard: list, counts: list) -> pa.RecordBatch:
                _scan(shard, tests)
                part = batch.slice(begin, len(shard))
                found = [[dict(zip(("item", "item_from", "from", "length"), x, strict=True)) for x in sorted(longest)] for *_, longest in shard]
                return pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(part.column(names.index(c)) for c in (*kept, *more)),
                        pa.array(counts, pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in _merged(spans)] for _, spans, *_ in shard], _SPANS),
                        pa.array([sorted(items) for _, _, items, _ in shard], _ITEMS),
                        pa.array(found, _LONGEST),
                    ],
                    ["doc_id", *kept, *more, "n_words", "spans", "items", "longest"],
                )

            def held(i: int, name: str) -> list:
                return batch.column(names.index(name))[i].as_py() if name in names else []

            for i in range(batch.num_rows):
                found = words(batch.column(1)[i].as_py())
                symbols = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
                longest = [(x["item"], x["item_from"], x["from"], x["length"]) for x in held(i, "longest")]
                shard.append((symbols, [(x["a"], x["b"]) for x in held(i, "spans")], set(held(i, "items")), longest))
                counts.append(len(found))
                size += len(found)
                if size >= SHARD_WORDS:
                    yield settle(begin, shard, counts)
                    begin, size, shard, counts = i + 1, 0, [], []
            if shard:
                yield settle(begin, shard, counts)

    return df.mapInArrow(work, schema)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    digests: bool = False,
) -> DataFrame:
    """(doc_id, n_words, spans, items, longest), one row per input row of ``docs``.

    spans: the word ranges [a, b) that windows of items cover, merged where they touch; items: ids, as strings
    and sorted, of the items with a window in the document; longest: the verbatim matches of at least a window that can't be made longer
    on either side, as (item, word of the item, word of the document, words). A window is ``window`` consecutive words of an item, the whole
    of a shorter item; items and documents without words match nothing, null texts have no words. Null item ids
    are the text ``null``. Repeated rows give repeated rows. Empty tables are taken as they are;
    further columns are not read. ``digests`` adds the digest of the text.

    Benchmarks of more than ``block_bytes`` go in blocks by a hash of item and text, a pass over the documents for each, written to
    the shared folder in between; the driver and each task hold one block at a time.
    """
    test = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")
    )
    total = test.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    more = [digest_of(text_col).alias("digest")] if digests else []
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    passes = Chain(docs.sparkSession, "decontamination-pass")
    for k in range(blocks):
        part = test.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else test
        df = _pass(df, Suffixes.of(sorted((r["item"], r["text"]) for r in part.collect()), window), k == blocks - 1)
        if k < blocks - 1:
            df = passes.put(df)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``; see ``matches``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return matches(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window. All columns stay.

    The verdict is on rows: of rows that share an id each goes by its own text, null ids included; repeated rows go or stay
    together. Null and empty texts stay, and so does everything where the benchmark is empty.
    """
    found = matches(docs, benchmark, id_col=id_col, text_col=text_col, digests=True, **options)
    return without_rows(docs, id_col, text_col, found.filter(F.size("spans") > 0).select("doc_id", "digest"))
