"""Nearest neighbours by Euclidean distance, vector caches, and the contract of embedding models."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_CHUNKS, CANDIDATE_SESSIONS = 200, 100
EMBED_BATCH, MOST_EMBED_BATCH, ERROR_CHARS = 32, 128, 2000
#: Queries that may be broadcast.
MOST_QUERIES = 1024
#: Queries and vectors of a comparison task, where the queries are many.
BLOCK_QUERIES, BLOCK_VECTORS = 512, 65_536
#: Vectors that a comparison task holds as double numbers at once.
SLICE_VECTORS = 4096


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATE_CHUNKS, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """(query, chunk_id, distance, vector_rank): the exact k nearest vectors of each row of ``queries(query, vector)``.

    The queries are a stated set; every vector is compared with each. Up to MOST_QUERIES of them are broadcast, more go the way of
    ``nearest_of_many`` (which takes numbers as ids). Each task keeps the k best of a query before the shuffle. Vectors whose width differs from the query's, and null ones, never match. Ties go by id.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        return nearest_of_many(vectors, queries, k, id_col, vec_col)
    fits = F.size(vec_col) == F.size("vector")
    pairs = vectors.join(F.broadcast(queries.select("query", "vector")), fits).select(
        "query", F.col(id_col).alias("chunk_id"), l2(F.col(vec_col), F.col("vector")).alias("distance")
    )
    best = Window.partitionBy("query").orderBy("distance", "chunk_id")
    return pairs.withColumn("vector_rank", F.row_number().over(best)).filter(F.col("vector_rank") <= max(1, k))


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATE_CHUNKS, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """What ``nearest`` gives, for queries that grow with the table: blocks of both meet in tasks, and a task hands on the k best of a query.

    Ids are numbers; vectors hold no nulls.
    """
    k = max(1, k)
    asked, known = queries.filter("vector is not null"), vectors.filter(F.col(vec_col).isNotNull())
    cut_q, cut_v = max(1, -(-asked.count() // BLOCK_QUERIES)), max(1, -(-known.count() // BLOCK_VECTORS))

    def block(c: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def to_all(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    sides = asked.select(block(F.col("query"), cut_q).alias("i"), to_all(cut_v).alias("j"), F.lit(True).alias("asks"), F.col("query").cast("long").alias("id"), "vector")
    sides = sides.unionByName(
        known.select(to_all(cut_q).alias("i"), block(F.col(id_col), cut_v).alias("j"), F.lit(False).alias("asks"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    )

    def compare(part: pa.Table) -> pa.Table:
        asks, ids = part.column("asks").to_numpy(), part.column("id").to_numpy()
        width = pc.list_value_length(part.column("vector")).to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows(places: np.ndarray, w: int) -> np.ndarray:
            flat = part.column("vector").take(pa.array(places)).combine_chunks().flatten()
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w)

        for w in np.unique(width[asks]):
            own, asking = np.flatnonzero(~asks & (width == w)), np.flatnonzero(asks & (width == w))
            own = own[np.argsort(ids[own], kind="stable")]  # ties go by id
            wanted = rows(asking, w)
            best = [(own[:0], np.zeros(0))] * asking.size
            for at in range(0, own.size, SLICE_VECTORS):
                some = own[at : at + SLICE_VECTORS]
                x = rows(some, w)
                for n, vector in enumerate(wanted):
                    apart = x - vector
                    distance = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                    near, so_far = some, best[n]
                    if so_far[0].size == k:  # a later id has to be nearer
                        nearer = np.flatnonzero(distance < so_far[1][-1])
                        near, distance = some[nearer], distance[nearer]
                    if near.size > k:
                        kept = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                        near, distance = near[kept], distance[kept]
                    if near.size:
                        near, distance = np.r_[so_far[0], near], np.r_[so_far[1], distance]
                        order = np.argsort(distance, kind="stable")[:k]
                        best[n] = near[order], distance[order]
            found += [(np.full(near.size, ids[q]), ids[near], distance) for q, (near, distance) in zip(asking, best, strict=True) if near.size]
        query, chunk, distance = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": query, "chunk_id": chunk, "distance": distance})

    pairs = sides.groupBy("i", "j").applyInArrow(compare, "query long, chunk_id long, distance double")
    best = Window.partitionBy("query").orderBy("distance", "chunk_id")
    return pairs.withColumn("vector_rank", F.row_number().over(best)).filter(F.col("vector_rank") <= k)


def best_by_session(hits: DataFrame, text_col: str | None = None, key: str = "uid", limit: int = CANDIDATE_SESSIONS) -> DataFrame:
    """(query, uid, distance, vector_rank, vector_score[, text]): the nearest chunk of each session, ranked anew."""
    near = F.struct("distance", "chunk_id")
    best = hits.groupBy("query", key).agg(
        F.min("distance").alias("distance"),
        F.min_by("chunk_id", near).alias("chunk_id"),
        *([F.min_by(text_col, near).alias(text_col)] if text_col else []),
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return best.withColumn("vector_rank", rank).filter(F.col("vector_rank") <= limit).withColumn("vector_score", vector_score(F.col("distance")))


def vector_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(F.lit(0.0), distance))


class Embedder(Protocol):
    """A model that turns texts into vectors of a fixed width."""

    model_key: str
    dimensions: int

    def embed(self, texts: Sequence[str], input_type: str) -> np.ndarray: ...


class HashingEmbedder:
    """A stand-in without a model, for tests: signed hashes of words, scaled to length one."""

    def __init__(self, dimensions: int = 64, model_key: str = "hashing"):
        self.dimensions, self.model_key = dimensions, model_key

    def embed(self, texts: Sequence[str], input_type: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out


def query_hash(model_key: str, text: str) -> str:
    return hashlib.sha256(f"{model_key}\0query\0{text}".encode()).hexdigest()


def checked(vectors: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    vectors = np.asarray(vectors, np.float32)
    if vectors.shape != (n, dimensions):
        raise ValueError(f"expected {n} vectors of {dimensions} numbers, got shape {vectors.shape}")
    if not np.isfinite(vectors).all():
        raise ValueError("a vector has a number that is not finite")
    return vectors


def valid_vector(vector: Column, dimensions: int) -> Column:
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def cache_split(pending: DataFrame, cache: DataFrame, model_key: str, dimensions: int) -> DataFrame:
    """``pending`` chunks with the cached ``vector`` of their embed_sha256, null where there is none."""
    known = cache.filter((F.col("model") == model_key) & (F.col("dimensions") == dimensions)).select("embed_sha256", "vector")
    return pending.join(known, "embed_sha256", "left")


def embed_chunks(chunks: DataFrame, embedder: Embedder, text_col: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """(chunk_id, embed_sha256, vector, error): a batch that fails gives its chunks no vector and the message."""
    size = max(1, min(batch, MOST_EMBED_BATCH))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), size):
                some = part.iloc[a : a + size]
                try:
                    made = checked(embedder.embed(some["text"].tolist(), "document"), len(some), embedder.dimensions)
                    yield some[["chunk_id", "embed_sha256"]].assign(vector=list(made), error=None)
                except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its batch
                    yield some[["chunk_id", "embed_sha256"]].assign(vector=None, error=str(e)[:ERROR_CHARS])

    kind = dict(chunks.dtypes)["chunk_id"]
    return chunks.select("chunk_id", "embed_sha256", F.col(text_col).alias("text")).mapInPandas(
        work, f"chunk_id {kind}, embed_sha256 string, vector array<float>, error string"
    )
