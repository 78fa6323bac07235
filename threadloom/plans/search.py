"""Search and recent sessions, each as one lazy plan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.tokens import folded
from threadloom.operators import lexical, ranking, snippets, vectors
from threadloom.operators.lexical import Index
from threadloom.operators.ranking import Weights
from threadloom.operators.segments import SegmentedIndex
from threadloom.operators.store import Store
from threadloom.plans.query import Filters, ParsedQuery, TextPlan, parse_query

BROWSE_CANDIDATES = 500
RESULT = (
    "uid", "provider", "native_id", "title", "repo", "branch", "surface", "cwd", "updated_at", "created_at", "is_subagent", "message_count",
    "models", "resume_cmd", "fork_cmd", "snippet", "snippet_source", "score", "keyword_score", "vector_score",
)


@dataclass(frozen=True)
class Corpus:
    """What a search reads: sessions, their documents (uid, body), the lexical index by uid, and chunk vectors if there are any."""

    sessions: DataFrame
    docs: DataFrame
    index: Index
    chunk_vectors: DataFrame | None = None  # chunk_id, uid, embedding, text

    @classmethod
    def of(cls, sessions: DataFrame, docs: DataFrame, chunk_vectors: DataFrame | None = None, stemmed: bool = True) -> Corpus:
        fields = docs.select("uid", "title", "first_prompt", "body")
        return cls(sessions, docs, lexical.build_index(fields, "uid", lexical.SESSION_WEIGHTS, stemmed), chunk_vectors)


def follow_index(store: Store) -> SegmentedIndex:
    """The lexical index of a store, brought up to its documents: only those that are new or changed since the last time are read for words."""
    index, version = SegmentedIndex(store.spark, f"{store.root}/_index", lexical.SESSION_WEIGHTS), store.version("session_docs")
    if index.state()["of"] != version:
        index.refresh(store.read("session_docs"), "uid", version)
    return index


def stored_corpus(store: Store) -> Corpus:
    """The corpus of a store, with an index that is kept beside its tables and follows them."""
    docs, index = store.read("session_docs"), follow_index(store).index()
    vectors_ = store.read("chunk_embeddings").join(store.read("chunks").select("chunk_id", "text"), "chunk_id")
    return Corpus(store.read("sessions"), docs, index, vectors_)


@dataclass(frozen=True)
class Context:
    """Where and when a search is made."""

    now: datetime | None = None
    current_repo: str | None = None
    current_cwd: str | None = None
    weights: Weights = Weights()

    @property
    def moment(self) -> datetime:
        return self.now or datetime.now(UTC)


def one_query(corpus: Corpus, text: str) -> DataFrame:
    plan = TextPlan.of(text)
    spark = corpus.sessions.sparkSession
    return spark.createDataFrame([(0, list(plan.tokens))], "query int, phrases array<string>")


def keyword_hits(corpus: Corpus, text: str, limit: int = lexical.CANDIDATES, among: DataFrame | None = None) -> DataFrame:
    """(uid, bm25, keyword_rank, keyword_score) of the best sessions, of those ``among`` only if given."""
    terms = [w for t in TextPlan.of(text).tokens for w in folded(t)]
    index = corpus.index.only(terms) if corpus.index.tokens is lexical.stemmed_tokens else corpus.index  # terms are stems
    phrases = lexical.phrase_table(index, one_query(corpus, text), F.col("phrases"))
    scored = lexical.bm25(index, phrases)
    if among is not None:
        scored = scored.join(among.select(F.col("uid").alias("doc")), "doc", "left_semi")
    return lexical.top_keyword_hits(scored, limit).drop("query").withColumnRenamed("doc", "uid")


def vector_hits(corpus: Corpus, vector: list[float], among: DataFrame | None = None, limit: int = vectors.CANDIDATE_SESSIONS) -> DataFrame:
    """(uid, semantic_snippet, vector_rank, vector_score) of the nearest sessions."""
    table = corpus.chunk_vectors
    if among is not None:
        table = table.join(among.select("uid"), "uid", "left_semi")
    query = table.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query int, vector array<float>")
    near = vectors.nearest(table, query, max(limit, vectors.CANDIDATE_CHUNKS)).join(table.select("chunk_id", "uid", "text"), "chunk_id")
    best = vectors.best_by_session(near, "text", "uid", limit)
    return best.select("uid", F.col("text").alias("semantic_snippet"), "vector_rank", "vector_score")


def search(
    corpus: Corpus,
    query: str | ParsedQuery,
    context: Context = Context(),
    limit: int | None = None,
    vector: list[float] | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """RESULT rows, best first, with ``position`` from 1.

    ``vector`` is the query's embedding; without it, or without chunk vectors, the search is by keywords only. Filters apply to the
    candidates, or with ``prefilter`` to all sessions before candidates are taken. A query without free text gives recent sessions.
    """
    parsed = parse_query(query, context.moment) if isinstance(query, str) else query
    condition = ranking.filter_condition(parsed.filters)
    if not parsed.free_text:
        return browse(corpus, parsed.filters, context, limit, prefilter)
    plan = TextPlan.of(parsed.free_text)
    among = corpus.sessions.filter(condition) if prefilter else None
    found = keyword_hits(corpus, parsed.free_text, among=among)
    if vector is not None and corpus.chunk_vectors is not None:
        a = found.withColumn("query", F.lit(0))
        b = vector_hits(corpus, vector, among).withColumn("query", F.lit(0))
        found = ranking.fuse(a, b).drop("query")
    else:
        found = found.withColumns({"vector_rank": F.lit(None).cast("int"), "vector_score": F.lit(None).cast("double")})
    rows = found.join(corpus.sessions.drop("first_prompt"), "uid").filter(condition)
    rows = rows.join(corpus.docs.select("uid", "first_prompt", "body"), "uid")
    parts = ranking.score_parts(rows.columns, plan, context.moment, parsed.filters, context.current_repo, context.current_cwd, context.weights)
    rows = rows.withColumn("score", ranking.rounded(parts["total"], context.weights.score_digits))
    phrases = [folded(t) for t in plan.tokens]
    order = ranking.search_order(plan)
    rows = rows.orderBy(*order).limit(limit if limit and limit > 0 else lexical.CANDIDATES + vectors.CANDIDATE_SESSIONS)
    hit = F.when(F.col("keyword_rank").isNotNull(), snippets.full_text_snippet(F.col("body"), phrases))
    return _shaped(rows.withColumn("fts_snippet", hit), parsed.free_text, order)


def browse(corpus: Corpus, filters: Filters, context: Context = Context(), limit: int | None = None, prefilter: bool = False, candidates: int = BROWSE_CANDIDATES) -> DataFrame:
    """The latest sessions that meet the filters, by their browse score."""
    condition = ranking.filter_condition(filters)
    latest = corpus.sessions.filter(condition) if prefilter else corpus.sessions
    latest = latest.orderBy(F.desc("updated_at"), F.desc("uid")).limit(candidates).filter(condition)
    rows = latest.join(corpus.docs.select("uid", "body"), "uid")
    total = ranking.browse_parts(context.moment, filters, context.current_repo, context.current_cwd, context.weights)["total"]
    none = {"keyword_rank": "int", "keyword_score": "double", "vector_rank": "int", "vector_score": "double"}
    rows = rows.withColumns({"score": total, "preview_snippet": F.col("body"), **{k: F.lit(None).cast(v) for k, v in none.items()}})
    order = ranking.browse_order()
    return _shaped(rows.orderBy(*order).limit(limit if limit and limit > 0 else candidates), "", order)


def recent(corpus: Corpus, limit: int, context: Context = Context()) -> DataFrame:
    """The latest sessions without subagents."""
    main = Corpus(corpus.sessions.filter(~F.col("is_subagent")), corpus.docs, corpus.index)
    n = max(1, int(limit)) if math.isfinite(limit) else BROWSE_CANDIDATES
    return browse(main, Filters(), context, n, candidates=n)


def _shaped(rows: DataFrame, free_text: str, order: list) -> DataFrame:
    snippet, source = snippets.choose(rows.columns, free_text)
    # the page is bounded by its limit, so one task may number it
    placed = rows.withColumns({"snippet": snippet, "snippet_source": source}).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return placed.select("position", *RESULT)


def to_json(results: DataFrame) -> DataFrame:
    """One JSON text per result."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))
