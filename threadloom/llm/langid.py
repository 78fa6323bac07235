"""Language identification with a byte convolutional network in numpy.

Bytes of normalised text (lower case, ASCII other than letters as one space) are embedded, convolved with filters of
several widths, max-pooled over a window and mapped to a softmax over languages. The model is fitted on
the driver from a bounded, stratified sample of labelled texts; every window of every text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import digest_of, without_rows

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
EMBED = 8
#: The sample: about so many documents of each of at most so many languages, with so many excerpts of each.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_EXCERPTS = 800, 160_000, 3
UNKNOWN = "und"
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    embedding: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # widest * EMBED x all filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).split())


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes, the last padded with spaces, and how many bytes of each are text."""
    n = max(1, -(-len(data) // WINDOW))
    rows = np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)
    used = np.full(n, WINDOW, np.float32)
    used[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return rows, used


def _columns(model_embedding: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each position the embedded bytes that the widest filter sees: (rows * positions) x (widest * EMBED)."""
    widest = max(WIDTHS)
    seen = model_embedding[rows]
    at = np.lib.stride_tricks.sliding_window_view(seen, widest, axis=1)
    return np.ascontiguousarray(at.transpose(0, 1, 3, 2)).reshape(-1, widest * EMBED)


def _pooled(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = _columns(model.embedding, rows)
    scores = (columns @ model.filters).reshape(len(rows), -1, model.filters.shape[1])
    best = scores.max(axis=1) + model.bias
    return np.maximum(best, 0), scores, columns


def probabilities(model: Model, rows: np.ndarray, batch: int = 64) -> np.ndarray:
    """Softmax over languages for each window."""
    out = np.empty((len(rows), len(model.languages)), np.float32)
    for a in range(0, len(rows), batch):
        hidden, _, _ = _pooled(model, rows[a : a + batch])
        z = hidden @ model.out + model.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[a : a + batch] = z / z.sum(axis=1, keepdims=True)
    return out


def fit(samples: list[tuple[str, str]], steps: int = 700, batch: int = 96, seed: int = 0) -> Model:
    """A model from (language, excerpt) pairs; the same pairs in the same order give the same model."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({lang for lang, _ in samples}))
    widest, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest, EMBED, filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(widest * EMBED, filters)
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(filters, np.float32),
        "out": rng.normal(0, 0.2, (filters, max(1, len(languages)))).astype(np.float32),
        "out_bias": np.zeros(max(1, len(languages)), np.float32),
    }
    if len(languages) > 1:
        data = [normalise(text)[:WINDOW] for _, text in samples]
        label = np.array([languages.index(lang) for lang, _ in samples])
        of = [np.flatnonzero(label == k) for k in range(len(languages))]
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(languages), batch)
            pick = [of[k][rng.integers(0, of[k].size)] for k in y]
            rows = np.full((batch, WINDOW), 32, np.uint8)
            for r, i in enumerate(pick):
                text = data[i]
                if rng.random() < 0.5 and len(text) > 24:  # short texts must be told apart too
                    n = int(rng.integers(16, len(text)))
                    a = int(rng.integers(0, len(text) - n + 1))
                    text = text[a : a + n]
                rows[r, : len(text)] = np.frombuffer(text, np.uint8)
            model = Model(languages, **p)
            hidden, scores, columns = _pooled(model, rows)
            z = hidden @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(batch), y] -= 1
            d /= batch
            g = {"out": hidden.T @ d, "out_bias": d.sum(axis=0)}
            back = (d @ p["out"].T) * (hidden > 0)
            at = scores.argmax(axis=1) + np.arange(batch)[:, None] * scores.shape[1]
            seen = columns[at]  # batch x filters x inputs
            g["bias"] = back.sum(axis=0)
            g["filters"] = np.einsum("bf,bfi->if", back, seen) * mask
            into = (back[:, :, None] * p["filters"].T[None]).reshape(batch, filters, widest, EMBED)
            positions = scores.argmax(axis=1)[:, :, None] + np.arange(widest)
            bytes_at = rows[np.arange(batch)[:, None, None], positions]
            g["embedding"] = np.zeros_like(p["embedding"])
            np.add.at(g["embedding"], bytes_at.ravel(), into.reshape(-1, EMBED))
            rate = 0.01 * (1 - 0.9 * step / steps)
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(languages, **p)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About SAMPLE_DOCS documents of each language, drawn by a hash of their ids, with SAMPLE_EXCERPTS excerpts each.

    Every language is learned; where there are so many that this would come to more than SAMPLE_ALL documents, each has its part of
    that number (the rarer ones all that they have).

    Only rows that aren't held out and have text and language. The driver gets at most
    about SAMPLE_ALL * SAMPLE_EXCERPTS excerpts of about a window, whatever the corpus holds.
    """
    own = docs.filter(~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    own = own.filter("text is not null and lang is not null")
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return []
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(counts)))
    chance = docs.sparkSession.createDataFrame(
        [(r["lang"], math.ceil(min(1.0, each / r["n"]) * (1 << 30))) for r in counts], "lang string, below long"
    )
    drawn = own.join(F.broadcast(chance), "lang").filter("pmod(xxhash64(id, 'langid'), 1073741824) < below")
    excerpts = [
        F.expr(f"substring(text, cast(1 + pmod(xxhash64(id, {k}), greatest(1, length(text) - {WINDOW})) as int), {WINDOW})")
        for k in range(SAMPLE_EXCERPTS)
    ]
    rows = drawn.select("lang", F.explode(F.array_distinct(F.array(*excerpts))).alias("excerpt"))
    limit = 2 * max(SAMPLE_ALL, len(counts)) * SAMPLE_EXCERPTS  # the draw is by chance; twice its mean is never met
    return sorted((r["lang"], r["excerpt"]) for r in rows.limit(limit).collect())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row. Null texts and texts without a letter: ``und`` with score 0.

    ``digests`` adds the digest of the text, so that a row can be told from others with its id.
    """

    def scored(texts: list[str | None], has: list[bool]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))

        def settle(held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            if not held:
                return
            got = probabilities(model, np.concatenate([r for _, r, _ in held]))
            got *= np.concatenate([u for _, _, u in held])[:, None]
            starts = np.cumsum([0, *(len(u) for _, _, u in held)])[:-1]
            sums = np.add.reduceat(got, starts, axis=0)
            for (i, _, used), row in zip(held, sums, strict=True):
                k = int(row.argmax())
                names[i] = model.languages[k]
                score[i] = min(1.0, float(row[k]) / float(used.sum()))

        held, rows = [], 0
        for i, text in enumerate(texts):
            if has[i] and model.languages:
                held.append((i, *windows(normalise(text))))
                rows += len(held[-1][2])
                if rows >= 1024:
                    settle(held)
                    held, rows = [], 0
        settle(held)
        return names, score

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                names, score = scored(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score), *part.columns[3:]], ["doc_id", "lang_pred", "score", *part.schema.names[3:]]
                )

    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    more = [digest_of(text_col).alias("digest")] if digests else []
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), letters.alias("letters"), *more)
    return own.mapInArrow(work, "doc_id long, lang_pred string, score double" + ", digest binary" * digests)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    Fits the model on labelled rows that aren't held out, then predicts every row from its text alone. With no
    labelled row at all every text is ``und``. Repeated rows give repeated rows; an empty table gives an
    empty result; further columns are not read.
    """
    model = fit(training_sample(docs, id_col, text_col, lang_col))
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """``docs`` without those whose language is unknown or scored below ``least``. All columns stay.

    The verdict is on rows: of rows that share an id each goes by its own text, null ids included; repeated rows go or stay
    together. Null and empty texts go. An empty table gives an empty result.
    """
    model = fit(training_sample(docs, id_col, text_col, lang_col))
    found = predict(docs, model, id_col, text_col, digests=True)
    return without_rows(docs, id_col, text_col, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("doc_id", "digest"))
