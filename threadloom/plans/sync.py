"""Sync: bring the tables of a store up to date with the transcript files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.operators import chunks as chunking
from threadloom.operators import store as tables
from threadloom.operators import vectors
from threadloom.operators.sessions import default_repo, normalize
from threadloom.operators.store import Store
from threadloom.schemas import CHUNK_VERSION, PROVIDERS
from threadloom.sources import transcripts


@dataclass
class Summary:
    discovered: int = 0
    changed: int = 0
    indexed: int = 0
    failed: int = 0
    deleted_sources: int = 0
    deleted_sessions: int = 0
    chunked_sessions: int = 0
    chunks: int = 0
    embedded_chunks: int = 0
    reused_embeddings: int = 0
    embedding_failures: int = 0
    semantic_status: str = "disabled"

    def json(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)]).select(F.to_json(F.struct("*")).alias("json"))


def run_sync(
    spark: SparkSession,
    store: Store,
    roots: dict[str, list[str]],
    now: str,
    config: Config = Config(),
    embedder: vectors.Embedder | None = None,
    full: bool = False,
    provider: str | None = None,
    repo: Callable[[Column], Column] = default_repo,
    progress: Callable[[str], None] = lambda step: None,
) -> Summary:
    """One pass: list, parse what changed, merge, store, forget what is gone, chunk and embed.

    A session whose files changed in part is merged again from all of its files. A file gets into the manifest when it
    has been parsed, so one that fails is tried again. Tables are changed in the buckets that hold what changed; one sync writes
    a store at a time (``Store.writing``).
    """
    with store.writing():
        return _one_pass(spark, store, roots, now, config, embedder, full, provider, repo, progress)


def _one_pass(spark, store, roots, now, config, embedder, full, provider, repo, progress) -> Summary:
    out = Summary()
    chosen = [provider] if provider else list(PROVIDERS)
    roots = {p: list(roots.get(p, [])) for p in chosen}
    if full:
        store.clear(provider)

    progress("listing files")
    found = store.stage(transcripts.discover(spark, roots).drop("relative"))
    manifest = store.read("sources")
    own = manifest.filter(F.col("provider").isin(*chosen))
    links = store.read("session_sources")
    gone = store.stage(tables.deleted_files(found, own).select("path"))
    changed = store.stage(tables.changed_files(found, own).select("provider", "path", "size", "mtime_ms", "likely_subagent"))
    out.discovered, out.changed, out.deleted_sources = found.count(), changed.count(), gone.count()

    if not (out.changed or out.deleted_sources):  # no file is opened
        _drop_orphans(store, out)
        index_chunks(spark, store, links.select("uid").limit(0), now, config, embedder, out)
        store.clear_stages()
        store.vacuum()
        return out

    progress("parsing what changed")
    # parse what changed; then the other files of every session it touches
    # a file is opened once and its lines are parsed once: contents, then what they say, are staged
    read = store.stage(transcripts.contents(spark, roots, changed))
    parsed, failures = transcripts.split_failures(store.stage(transcripts.parse_all(read)))
    hit = changed.select("path").unionByName(gone)
    touched = parsed.select(F.concat_ws(":", "provider", "native_id").alias("uid")).unionByName(
        links.join(hit, "path", "left_semi").select("uid")
    )
    siblings = links.join(touched.distinct(), "uid", "left_semi").select("path").distinct()
    others = store.stage(found.join(siblings, "path", "left_semi").join(changed.select("path"), "path", "left_anti"))
    if not others.isEmpty():
        more = store.stage(transcripts.contents(spark, roots, others))
        again = transcripts.split_failures(store.stage(transcripts.parse_all(more)))
        parsed, failures = (a.unionByName(b) for a, b in zip((parsed, failures), again, strict=True))
        read = read.unionByName(more)
    documents = store.stage(normalize(parsed, now, config.prefer_pi_session_id, repo))
    out.indexed, out.failed = documents.count(), failures.count()

    stamps = (F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"), F.lit(None).cast("string").alias("last_error"))
    seen = store.stage(
        read.select("path", "provider", "size", "mtime_ms", "sha256", *stamps).join(failures.select("path"), "path", "left_anti")
    )

    progress("writing sessions")
    with store.together():
        new_links = documents.select("uid", F.explode("transcript_paths").alias("path"))
        links = store.change("session_sources", ["uid"], new=new_links)
        store.change("session_sources", ["uid", "path"], gone=links.join(gone, "path", "left_semi"))
        store.change("session_docs", ["uid"], new=documents.select("uid", "title", "first_prompt", "body"))
        store.change("sessions", ["uid"], new=documents)
        store.change("sources", ["path"], new=seen, gone=gone, keep=("first_seen_at",))
        errors = failures.select("path", "provider", "error", F.lit(now).alias("updated_at"))
        cleared = seen.select("path").unionByName(gone)
        store.change("parse_errors", ["path"], new=errors, gone=cleared)

        lost = _drop_orphans(store, out)
    progress("chunking and embedding")
    index_chunks(spark, store, documents.select("uid").join(lost, "uid", "left_anti"), now, config, embedder, out)
    store.clear_stages()
    store.vacuum()
    return out


def _drop_orphans(store: Store, out: Summary) -> DataFrame:
    """Forgets the sessions that no file backs, and returns their uids."""
    lost = store.stage(tables.orphans(store.read("sessions"), store.read("session_sources")).select("uid"))
    out.deleted_sessions = lost.count()
    if out.deleted_sessions:
        with store.together():
            for table in ("chunk_embeddings", "chunks", "session_docs", "sessions"):
                store.change(table, ["uid"], gone=lost)
    return lost


def index_chunks(
    spark: SparkSession, store: Store, given: DataFrame, now: str, config: Config, embedder: vectors.Embedder | None, out: Summary
) -> None:
    """Chunk the given sessions and those that lack chunks; take vectors from the cache, then from the model."""
    key = embedder.model_key if embedder else config.embeddings.model_key
    width = embedder.dimensions if embedder else config.embeddings.dimensions
    redact = config.embeddings.redact_before_send
    version = chunking.chunk_version(CHUNK_VERSION, key, width, redact)
    sessions, old = store.read("sessions"), store.read("chunks")
    targets = store.stage(given.unionByName(tables.needs_chunks(sessions, old, version).select("uid")).distinct())
    docs = store.read("session_docs").join(targets, "uid", "left_semi")
    made = chunking.chunk_documents(docs, "uid", "body", config.chunk_tokens, config.chunk_overlap_tokens, config.max_chunks_per_session)
    made = store.stage(
        chunking.with_embed_hash(made, key, redact).withColumns(
            {
            "chunk_id": F.concat_ws("#", "uid", F.lpad("ord", 6, "0")),
            "embedding_status": F.lit("pending"),
            "embedding_error": F.lit(None).cast("string"),
            "embedded_at": F.lit(None).cast("string"),
        }
    ))
    out.chunked_sessions, out.chunks = targets.count(), made.count()
    store.change("chunk_embeddings", ["uid"], gone=targets)
    current = store.change("chunks", ["uid"], new=made, gone=targets)
    store.change("sessions", ["uid"], new=sessions.join(targets, "uid", "left_semi").withColumn("chunk_version", F.lit(version)))
    if not config.embeddings.enabled:
        return
    out.semantic_status = "ready" if embedder else "not_ready"
    pending = tables.pending_chunks(current, store.read("sessions"), None)
    split = store.stage(vectors.cache_split(pending, store.read("embedding_cache"), key, width))
    reused = split.filter("vector is not null").select("chunk_id", "embed_sha256", "vector", F.lit(None).cast("string").alias("error"))
    out.reused_embeddings = reused.count()
    done = reused
    if embedder:
        todo = split.filter("vector is null")
        # a text is redacted and sent once, however many chunks have it
        once = todo.groupBy("embed_sha256").agg(F.min_by(F.struct("chunk_id", "text"), "chunk_id").alias("one")).select("embed_sha256", "one.*")
        once = once.withColumn("text", chunking.redacted(F.col("text"))) if redact else once
        fresh = store.stage(vectors.embed_chunks(once, embedder, batch=config.embeddings.batch_size))
        good = fresh.filter("vector is not null")
        add = good.select("embed_sha256", F.lit(key).alias("model"), F.lit(width).alias("dimensions"), "vector")
        store.change("embedding_cache", ["embed_sha256", "model", "dimensions"], new=add)
        done = done.unionByName(todo.select("chunk_id", "embed_sha256").join(fresh.drop("chunk_id"), "embed_sha256").select("chunk_id", "embed_sha256", "vector", "error"))
    done = store.stage(done)
    out.embedded_chunks, out.embedding_failures = done.filter("vector is not null").count(), done.filter("vector is null").count()
    added = done.filter("vector is not null").join(current.select("chunk_id", "uid"), "chunk_id").select("chunk_id", "uid", F.col("vector").alias("embedding"))
    store.change("chunk_embeddings", ["uid", "chunk_id"], new=added)
    state = done.select("chunk_id", F.col("vector").isNotNull().alias("ok"), "error")
    marked = current.join(state, "chunk_id").withColumns(
        {
            "embedding_status": F.when(F.col("ok"), "embedded").otherwise("failed"),
            "embedding_error": F.col("error"),
            "embedded_at": F.when(F.col("ok"), F.lit(now)).otherwise(F.col("embedded_at")),
        }
    )
    store.change("chunks", ["uid", "chunk_id"], new=store.stage(marked.select(*current.columns)))
