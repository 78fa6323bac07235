"""Phrase collocations by hierarchical pair naming.

Texts become sequences of the ids of their frequent words, with a break where a rarer word or a piece's end stands. A frequent phrase of
k words is a pair of adjacent phrases of k - 1 words, so a level counts pairs of adjacent ids, gives each frequent pair an id of its own, and
puts that id in the place of the pair; its table of (id, left, right) is what the level's joins name pairs by. The same columns are
the parent pointers: along the left parents lie a phrase's beginnings, along the right ones its ends, which is all that cuts ask for, and a
phrase's left and right parents are all the phrases of one word less inside it.

Pairs are counted in each task before anything is shuffled. A table of names of up to ``BROADCAST_BYTES`` goes to the tasks; a larger one is joined.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_BYTES, slices, table_bytes, written

LEAST, WORDS, SHARE, TOP = 30, 4, 80, 2000
_TOKEN = re.compile(rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
_ENDS = frozenset(bytes([c]) for c in b".,;:!?\n\v\f\r")
#: Distinct words that a task counts before it hands them on, and ids that it pairs at a time.
_HELD, _IDS = 100_000, 500_000
_NONE = -1


def tokens(text: bytes) -> list[bytes]:
    """Words in order, A-Z in lower case, and between them the single marks that end a piece."""
    return _TOKEN.findall(text.lower())  # bytes: ASCII letters only


def _word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, f) of the frequent words, and for each language a row of null word with the number of all words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            found = [(lang, word, n) for lang, c in held.items() for word, n in c.items() if word not in _ENDS]
            found += [(lang, None, sum(n for w, n in c.items() if w not in _ENDS)) for lang, c in held.items()]
            held.clear()
            lang, word, f = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(f, pa.int64())], ["lang", "word", "f"])

        held: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[lang].update(tokens(text.as_py()))
                if sum(map(len, held.values())) > _HELD:
                    yield rows()
        yield rows()

    counted = docs.mapInArrow(work, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counted.filter(F.col("word").isNull() | (F.col("f") >= least))


def _compact(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Lists of these ids where a run of breaks is one break."""
    keep = np.ones(ids.size, bool)
    keep[1:] = (ids[1:] != _NONE) | (ids[:-1] != _NONE)
    before = np.r_[0, np.cumsum(keep)]
    return pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), pa.array(ids[keep]))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of lists, and where each list begins and ends among them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pair_counts(rows: DataFrame, least: int) -> DataFrame:
    """(left, right, f) of the frequent pairs of adjacent ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            names, places = np.unique(np.concatenate([left, right]), return_inverse=True)
            pairs, f = np.unique(places[: left.size] * names.size + places[left.size :], return_counts=True)
            first, second = np.divmod(pairs, max(names.size, 1))
            return pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array(names[second]), pa.array(f.astype(np.int64))], ["left", "right", "f"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches):
            ids, offsets = _lists(batch.column(0))
            ends = np.zeros(ids.size + 1, bool)
            ends[offsets[1:]] = True  # between the last id of a text and the first of the next
            for a in range(0, max(ids.size - 1, 0), _IDS):
                left, right = ids[a : min(a + _IDS, ids.size - 1)], ids[a + 1 : a + 1 + _IDS]
                whole = (left != _NONE) & (right != _NONE) & ~ends[a + 1 : a + 1 + left.size]
                held.append((left[whole], right[whole]))
                if sum(x.size for x, _ in held) > 2 * _IDS:
                    yield counted()
        if held:
            yield counted()

    counted = rows.select("ids").mapInArrow(work, "left long, right long, f long").groupBy("left", "right").agg(F.sum("f").alias("f"))
    return counted.filter(F.col("f") >= least)


def _regrouped(hits: DataFrame) -> DataFrame:
    """(row, ids) of ``hits(row, at, id)``: ids in order, with a break wherever places aren't adjacent."""
    place = F.array_sort(F.collect_list(F.struct("at", "id"))).alias("h")
    joined = F.expr("flatten(transform(h, (x, i) -> if(i > 0 and x.at = get(h, i - 1).at + 1, array(x.id), array(-1L, x.id))))")
    return hits.groupBy("row").agg(place).select("row", joined.alias("ids"))


def name_words(docs: DataFrame, words: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, ids) of ``docs(row, lang, text)`` by ``words(id, lang, word)``; texts without a frequent word are left out."""
    if table_bytes(words, "lang", "word") <= most_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(words.select("id", "lang", F.col("word").cast("binary")).toArrow())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = defaultdict(dict)
            for lang, word, i in zip(*(sent.value.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
                known[lang][word] = i
            for batch in slices(batches):
                found = []
                for lang, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    get = known[lang].get
                    found.append(np.array([get(w, _NONE) for w in tokens(text.as_py())], np.int64))
                offsets = np.r_[0, np.cumsum([x.size for x in found])].astype(np.int64)
                ids = np.concatenate([np.zeros(0, np.int64), *found])
                yield pa.RecordBatch.from_arrays([batch.column(0), _compact(ids, offsets)], ["row", "ids"])

        return docs.select("row", "lang", "text").mapInArrow(work, "row long, ids array<long>").filter("exists(ids, x -> x >= 0)")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[w.decode() for w in tokens(x.as_py())] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["row", "lang", "words"])

    each = docs.select("row", "lang", "text").mapInArrow(split, "row long, lang string, words array<string>")
    return _regrouped(each.select("row", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"]))


def name_pairs(rows: DataFrame, pairs: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows(row, ids)`` with the id of ``pairs(id, left, right)`` for each pair of adjacent ids; what holds no pair is left out."""
    if 24 * pairs.count() <= most_bytes:
        sent = rows.sparkSession.sparkContext.broadcast(pairs.select("left", "right", "id").toArrow())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left, right, name = (sent.value.column(c).to_numpy() for c in ("left", "right", "id"))
            parts = [np.unique(x, return_inverse=True) for x in (left, right)]
            (lefts, at), (rights, to) = parts
            code = at.astype(np.int64) * max(rights.size, 1) + to
            order = np.argsort(code)
            code, name = code[order], name[order]
            for batch in slices(batches):
                ids, offsets = _lists(batch.column(1))
                out = np.full(ids.size, _NONE, np.int64)
                for a in range(0, max(ids.size - 1, 0), _IDS):
                    x, y = ids[a : min(a + _IDS, ids.size - 1)], ids[a + 1 : a + 1 + _IDS]
                    i, j = (np.minimum(np.searchsorted(s, v), max(s.size - 1, 0)) for s, v in ((lefts, x), (rights, y)))
                    some = np.flatnonzero((lefts[i] == x) & (rights[j] == y)) if name.size else np.zeros(0, np.int64)
                    wanted = i[some].astype(np.int64) * rights.size + j[some]
                    k = np.minimum(np.searchsorted(code, wanted), max(code.size - 1, 0))
                    same = code[k] == wanted
                    out[a + some[same]] = name[k[same]]
                out[np.maximum(offsets[1:] - 1, 0)[offsets[1:] > offsets[:-1]]] = _NONE  # a text's last id has none after it
                yield pa.RecordBatch.from_arrays([batch.column(0), _compact(out, offsets)], ["row", "ids"])

        return rows.select("row", "ids").mapInArrow(work, "row long, ids array<long>").filter("exists(ids, x -> x >= 0)")
    each = rows.select("row", F.posexplode(F.arrays_zip(F.col("ids").alias("left"), F.expr("slice(ids, 2, size(ids))").alias("right"))).alias("at", "p"))
    return _regrouped(each.select("row", "at", "p.left", "p.right").join(pairs.select("left", "right", "id"), ["left", "right"]))


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, words: int = WORDS, most_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``words`` words that stand at least ``least`` times in a language, and the (lang, n) of its words.

    (words, id, lang, phrase, last, f, left, right, begins, ends): ``left`` and ``right`` are the ids of the phrases of one word less inside,
    ``begins`` and ``ends`` how often its first and last 1, 2, ... words stand. Null texts are empty, null languages ``und``; rows are
    counted as often as they are repeated. An empty table gives empty tables. Further columns aren't read.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    )
    counts = written(_word_counts(own, least), "collocation-words")
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    named = written(counts.filter("word is not null").withColumn("id", F.monotonically_increasing_id()), "collocation-names")
    none = F.array().cast("array<long>")
    level = named.select(
        F.lit(1).alias("words"), "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("begins"), none.alias("ends"),
    )
    every, rows = level, written(name_words(own.withColumn("row", F.monotonically_increasing_id()), named, most_bytes), "collocation-ids")
    for k in range(2, words + 1):
        pairs = written(_pair_counts(rows, least).withColumn("id", F.monotonically_increasing_id()), "collocation-pairs")
        a = level.select(F.col("id").alias("left"), "lang", "phrase", F.col("f").alias("fl"), "begins")
        b = level.select(F.col("id").alias("right"), "last", F.col("f").alias("fr"), "ends")
        level = pairs.join(a, "left").join(b, "right").select(
            F.lit(k).alias("words"), "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "left", "right",
            F.array_append("begins", F.col("fl")).alias("begins"), F.array_append("ends", F.col("fr")).alias("ends"),
        )
        level = written(level, "collocation-level")
        every = every.unionByName(level)
        if k < words:
            rows = written(name_pairs(rows, pairs, most_bytes), "collocation-ids")
    return every, totals


def best_cut(f: str, words: str) -> Column:
    """(score, cut, l, r) of the cut with the lowest score, the first of equals; products go beyond 64 bits."""
    return F.array_min(
        F.expr(
            f"transform(sequence(1, {words} - 1), k -> struct(cast({f} as decimal(30, 0)) * 2000000 div (begins[k - 1] + ends[{words} - k - 1]) as score, "
            f"k as cut, begins[k - 1] as l, ends[{words} - k - 1] as r))"
        )
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    words: int = WORDS,
    share: int = SHARE,
    top: int = TOP,
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``words`` words.

    A phrase that stands ``a`` times is cut after some word into parts that stand ``l`` and ``r`` times; its score is
    floor(2000000 a / (l + r)) of the cut where that is lowest, the first of equals. Phrases inside a longer one that stands at least
    ``share`` percent as often are dropped: it is enough to look at those of one word more, as nothing longer stands more often than they.
    Order: score and ``a`` downward, then the phrase by its bytes. ``phrases`` tells what nulls and empty tables give.
    """
    every, totals = phrases(docs, text_col, lang_col, least, words, most_bytes)
    longer = every.filter("words > 2").select(F.col("words") - 1, F.explode(F.array("left", "right")), "f").toDF("words", "id", "f")
    most = longer.groupBy("words", "id").agg(F.max("f").alias("longest"))
    whole = every.filter("words > 1").join(most, ["words", "id"], "left")
    free = whole.filter(F.col("longest").isNull() | F.expr(f"cast(longest as decimal(30, 0)) * 100 < cast(f as decimal(30, 0)) * {int(share)}"))
    scored = free.withColumn("cut", best_cut("f", "words")).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
