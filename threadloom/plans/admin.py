"""Schema versions, reports and small reads around a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.operators.store import Store
from threadloom.operators.vectors import Embedder, query_hash
from threadloom.schemas import TABLES
from threadloom.functions.textops import redacted

#: Ordered schema steps; each runs once. A later step adds or rewrites tables.
MIGRATIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("001_init", ("index_meta", "sources", "sessions", "session_docs", "session_sources", "parse_errors")),
    ("002_semantic", ("chunks", "embedding_cache", "query_embedding_cache", "chunk_embeddings")),
)


def applied(store: Store) -> list[str]:
    rows = store.read("index_meta").filter(F.startswith("key", F.lit("migration:"))).select("key").collect()
    return sorted(r["key"].removeprefix("migration:") for r in rows)


def migrate(store: Store, now: str) -> list[str]:
    """Makes the tables that are missing and notes each step with its time; returns the steps that ran."""
    done, ran = set(applied(store)), []
    for name, tables in MIGRATIONS:
        if name in done:
            continue
        for table in tables:
            if not store.version(table):
                store.write(table, store.spark.createDataFrame([], TABLES[table]))
        notes = store.spark.createDataFrame([(f"migration:{name}", now), ("schema_version", name)], TABLES["index_meta"])
        store.change("index_meta", ["key"], new=notes)
        ran.append(name)
    store.clear_stages()
    return ran


def ensure_width(store: Store, dimensions: int) -> None:
    """The vectors of a store have one width; another one needs a full rebuild."""
    if not 1 <= dimensions <= 100_000:
        raise ValueError(f"a vector can't have {dimensions} numbers")
    other = store.read("chunk_embeddings").filter(F.size("embedding") != dimensions).limit(1).count()
    if other:
        raise ValueError(f"the stored vectors aren't {dimensions} wide: sync with full=True")


def report(store: Store, config: Config = Config(), embedder: Embedder | None = None) -> DataFrame:
    """(item, value): what the store holds and how searches would run."""
    status = store.status().first().asDict()
    rows = [*status.items(), ("embeddings", config.embeddings.label if config.embeddings.enabled else "disabled")]
    rows += [("model", config.embeddings.model_key), ("semantic", "ready" if embedder and status["vectors"] else "keyword only"), ("migrations", ",".join(applied(store)))]
    return store.spark.createDataFrame([(k, str(v)) for k, v in rows], "item string, value string")


def session(store: Store, uid: str) -> DataFrame:
    return store.read("sessions").filter(F.col("uid") == uid).join(store.read("session_docs").select("uid", "body"), "uid", "left")


def relink(store: Store, links: DataFrame) -> DataFrame:
    """Replaces the file links of the sessions in ``links(uid, path)``, for paths that the manifest knows."""
    known = links.join(store.read("sources").select("path"), "path", "left_semi").select("uid", "path")
    return store.change("session_sources", ["uid"], new=known, gone=links)


def merged_transcripts(contents: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, text): the files of each session under a header with their path, in order of path."""
    parts = contents.join(links, "path").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("fs"))
    return parts.select("uid", F.array_join(F.transform("fs", lambda f: F.concat(F.lit("# "), f["path"], F.lit("\n\n"), f["content"])), "\n\n").alias("text"))


def first_records(lines: DataFrame) -> DataFrame:
    """(path, raw): the first valid record of each file of ``json_lines``."""
    return lines.filter(~F.col("is_bad")).groupBy("path").agg(F.min_by("raw", "line_no").alias("raw"))


def embed_query(store: Store, embedder: Embedder, text: str, redact: bool = True) -> list[float]:
    """The query's vector, from the cache or from the model, which is then noted."""
    spark = store.spark
    sent = spark.createDataFrame([(text,)], "t string").select(redacted(F.col("t"))).first()[0] if redact else text
    key = query_hash(embedder.model_key, sent)
    cache = store.read("query_embedding_cache")
    known = cache.filter((F.col("query_sha256") == key) & (F.col("model") == embedder.model_key) & (F.col("dimensions") == embedder.dimensions))
    if row := known.select("vector").first():
        return list(row["vector"])
    vector = [float(x) for x in embedder.embed([sent], "query")[0]]
    new = spark.createDataFrame([(key, embedder.model_key, embedder.dimensions, vector)], TABLES["query_embedding_cache"])
    store.change("query_embedding_cache", ["query_sha256", "model", "dimensions"], new=new)
    return vector


def query_vector(store: Store, embedder: Embedder | None, text: str, redact: bool = True) -> tuple[list[float] | None, str]:
    """(the query's vector, "") or (None, why there is none): whatever a model does, a search by keywords goes on."""
    if not text.strip() or embedder is None:
        return None, ""
    try:
        if not store.read("chunk_embeddings").limit(1).count():
            return None, "no vectors are stored yet"
        ensure_width(store, embedder.dimensions)
        return embed_query(store, embedder, text, redact), ""
    except Exception as e:  # noqa: BLE001  a model's failure isn't the search's
        return None, f"the search is by keywords only: {e}"


def launch_warnings(provider: str, cwd: str, exists: Callable[[str], bool], search_path: str) -> list[str]:
    """What stands in the way of resuming a session here: its folder, or the provider's command below ``search_path``, isn't there."""
    found = any(exists(f"{folder}/{provider}") for folder in search_path.split(":") if folder)
    return [w for w, bad in ((f"the folder {cwd} is missing", not exists(cwd)), (f"{provider} is not on the path", not found)) if bad]


def result_window(count: int, selected: int, visible: int) -> tuple[int, int]:
    """(first, last) of the rows to show so that the selected one is about in the middle."""
    visible = max(1, visible)
    first = max(0, min(selected - visible // 2, count - visible))
    return first, min(count, first + visible)


def page(results: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of search results by position."""
    return results.filter((F.col("position") > first) & (F.col("position") <= last)).orderBy("position")
