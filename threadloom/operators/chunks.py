"""Chunking of session bodies for embedding."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.textops import BOUNDARY, WS, WS_CHARS, let, redacted

TARGET_TOKENS, OVERLAP_TOKENS, MAX_CHUNKS, EDGE_CHUNKS = 512, 96, 40, 8
LEAST_TARGET = 64
#: Characters of words whose estimates are kept, and of the chunks that a task hands on at once.
LONGEST_KEPT, CHUNK_CHARS = 64, 1 << 20

_WORD = re.compile(f"[^{WS}]+")
_PIECE = regex.compile(rf"[\p{{L}}\p{{N}}_-]+|[^{WS}]")

# What counts as an identifier, a code-like one, a role marker and a file path.
TERM = r"[A-Za-z_][A-Za-z0-9_./:-]{2,}"
CODE_LIKE = r"[._/:=-]|[a-z][A-Z]"  # a capital behind a small letter, wherever the run of small letters begins
ROLES = ("User:", "Assistant:")
ROLE = rf"(?<![A-Za-z0-9_])(?:{'|'.join(ROLES)})"
#: What every path holds; ``.js`` stands for ``.jsx`` and ``.json``, ``.ts`` for ``.tsx``.
PATH_ENDS = (".ts", ".js", ".md", ".sql", ".py", ".go", ".rs", ".css", ".html")
# the first look-behind follows from the second; it is one comparison and fails at most characters
PATH = rf"(?<![!-~])(?<![^{WS}])[A-Za-z0-9_./-]+\.(?:ts|tsx|js|jsx|json|md|sql|py|go|rs|css|html){BOUNDARY}"


@lru_cache(1 << 16)
def estimate(text: str) -> int:
    """Model tokens of a text without outer white space."""
    if text.isalnum():  # one piece
        return (len(text) + 3) // 4
    return max(1, math.ceil(max(len(_PIECE.findall(text)), len(text) / 4))) if text else 0


def windows(text: str, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of overlapping windows of about ``target`` tokens.

    A window takes whole words until it has enough tokens; the next one starts so far back that about ``overlap`` tokens are
    shared, but always behind the start of the one before.
    """
    target = max(LEAST_TARGET, target)
    overlap = max(0, min(overlap, target // 2))
    # numbers of each word, not the words: a text of one window may be large
    start, upto, total = array("q"), array("q", [0]), 0
    for m in _WORD.finditer(text):
        start.append(m.start())
        word = m[0]
        total += estimate(word) if len(word) <= LONGEST_KEPT else estimate.__wrapped__(word)
        upto.append(total)
    if not start:
        return
    start, upto = np.frombuffer(start, np.int64), np.frombuffer(upto, np.int64)
    end = np.r_[start[1:], len(text)]  # with the spaces behind the word
    first, n = 0, start.size
    while True:
        last = min(n, max(first + 1, int(np.searchsorted(upto, upto[first] + target))))
        yield int(start[first]), int(end[last - 1]), int(upto[last] - upto[first])
        if last == n:
            return
        back = max(1, int(np.searchsorted(upto, upto[last] - overlap, "right")) - 1) if overlap else last
        first = max(first + 1, back)


def info_score(text: Column, tokens: Column) -> Column:
    """Distinct identifiers per token, and more for code-like ones, role markers and file paths."""
    def by_terms(terms: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(terms, F.lower)))
        return distinct / F.greatest(F.lit(1), tokens) + F.size(F.filter(terms, lambda t: t.rlike(CODE_LIKE))) * 0.05

    def count(pattern: str, held: tuple[str, ...]) -> Column:
        """Matches of a pattern; a text with none of the literals that it needs isn't searched. Null for a null text."""
        some = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in held))
        return F.when(~some, 0).otherwise(F.regexp_count(text, F.lit(pattern)))

    terms = let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), by_terms)
    return terms + count(ROLE, ROLES) * 0.1 + count(PATH, PATH_ENDS) * 0.2


def cap(chunks: DataFrame, key: str = "uid", most: int = MAX_CHUNKS) -> DataFrame:
    """At most ``most`` chunks of each document: the first and last ones and the best of those between, numbered anew."""
    edge = min(EDGE_CHUNKS, most // 2)
    by = Window.partitionBy(key)
    n = F.count("*").over(by)
    marked = chunks.withColumns({"__n": n, "__at": F.row_number().over(by.orderBy("ord")) - 1})
    middle = (F.col("__n") > most) & (F.col("__at") >= edge) & (F.col("__at") < F.col("__n") - edge)
    best = F.row_number().over(Window.partitionBy(key, "__mid").orderBy(F.desc("info_score"), "ord"))
    kept = marked.withColumn("__mid", middle).withColumn("__best", best).filter(~F.col("__mid") | (F.col("__best") <= most - 2 * edge))
    return kept.withColumn("ord", (F.row_number().over(by.orderBy("ord")) - 1).cast("int")).drop("__n", "__at", "__mid", "__best")


def chunk_documents(
    docs: DataFrame,
    key: str = "uid",
    text_col: str = "body",
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    most: int = MAX_CHUNKS,
) -> DataFrame:
    """(uid, ord, text, approx_tokens, start_char, end_char, text_sha256, info_score) of each document's trimmed text.

    Blank and null texts have no chunks.
    """
    kind = dict(docs.dtypes)[key]

    names = ["uid", "ord", "text", "approx_tokens", "start_char", "end_char", "text_sha256"]
    types = pa.schema(list(zip(names[1:], (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)))

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *types.types), strict=True)], names)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are taken one at a time, and chunks handed on as soon as they have CHUNK_CHARS characters."""
        for part in parts:
            key_kind, rows, held = part.schema.field(0).type, [], 0
            for uid, given in zip(part.column(0), part.column(1)):
                text = (given.as_py() or "").strip(WS_CHARS)
                for ord_, (a, b, n) in enumerate(windows(text, target, overlap)):
                    chunk = text[a:b].strip(WS_CHARS)
                    rows.append((uid.as_py(), ord_, chunk, n, a, b, hashlib.sha256(chunk.encode()).hexdigest()))
                    held += len(chunk)
                    if held >= CHUNK_CHARS:
                        yield batch(rows, key_kind)
                        rows, held = [], 0
            if rows:
                yield batch(rows, key_kind)

    made = docs.select(F.col(key).alias("k"), F.col(text_col).alias("t")).mapInArrow(
        work, f"uid {kind}, ord int, text string, approx_tokens int, start_char int, end_char int, text_sha256 string"
    )
    return cap(made.withColumn("info_score", info_score(F.col("text"), F.col("approx_tokens"))), "uid", most)


def chunk_version(base: str, model_key: str, dimensions: int, redact: bool = True) -> str:
    return f"{base}:{model_key}:{dimensions}:{'redact' if redact else 'raw'}"


def with_embed_hash(chunks: DataFrame, model_key: str, redact: bool = True) -> DataFrame:
    """Adds the key under which a chunk's vector is cached: a hash of the model and of the text as it would be sent."""
    sent = redacted(F.col("text")) if redact else F.col("text")
    return chunks.withColumn("embed_sha256", F.sha2(F.concat(F.lit(model_key), F.lit("\0"), sent), 256))
