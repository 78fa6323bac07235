"""Registered queries of discovery, sync and maintenance, each with the SQL that says the same.

The first ones write conversations as transcript files of the three providers and take them in; the others fill the tables of a store
from the driver's tables.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.operators import lexical
from threadloom.operators import store as tables
from threadloom.operators.segments import SegmentedIndex
from threadloom.operators.store import Store
from threadloom.operators.vectors import HashingEmbedder
from threadloom.plans import admin
from threadloom.plans.sync import run_sync
from threadloom.queries import SESSIONS_SQL, bm25_sql, query, sessions, table
from threadloom.queries_text import codex_files, pi_files
from threadloom.schemas import TABLES
from threadloom.sources import transcripts

NOW = "2026-04-15T00:00:00.000Z"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, removed when the driver ends. A cluster must name its shared folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/threadloom/{uuid.uuid4().hex}-{label}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


# -- transcript files -----------------------------------------------------------------------------------------------------


def _claude_files(spark, d) -> DataFrame:
    stamp = F.concat(F.lit("2026-01-01T00:00:0"), F.col("turn"), F.lit("Z"))
    session = F.concat(F.lit("n"), F.col("conv_id") % 40).alias("sessionId")
    message = F.struct(F.col("role"), F.lit("m").alias("model"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.lit("user").alias("type"), stamp.alias("timestamp"), session, F.lit("/w/x").alias("cwd"), message.alias("message")))
    title = F.to_json(F.struct(F.lit("ai-title").alias("type"), session, F.concat(F.lit("T"), F.col("conv_id")).alias("aiTitle")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.first(title), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return files.select("conv_id", F.lit("claude").alias("provider"), "content")


def _tree(spark, d) -> DataFrame:
    """(provider, relative, content): a file for each conversation, and some that discovery passes over."""
    number = F.regexp_extract("path", r"(\d+)\.jsonl", 1).cast("long")
    codex, pi = (f(spark, d).select(number.alias("conv_id"), "provider", "content") for f in (codex_files, pi_files))
    c, padded = F.col("conv_id"), F.lpad(F.col("conv_id").cast("string"), 9, "0")
    files = (
        _claude_files(spark, d).filter(c % 3 == 0).unionByName(codex.filter(c % 3 == 1)).unionByName(pi.filter(c % 3 == 2))
    )
    folder = F.when(F.col("provider") == "claude", "-w-x/").when(F.col("provider") == "codex", "2026/01/rollout-").otherwise("s/")
    own = files.select("conv_id", "provider", F.concat(folder, padded, F.lit(".jsonl")).alias("relative"), "content")
    wrong = F.when(F.col("provider") == "claude", "node_modules/").when(F.col("provider") == "codex", "notes-").otherwise("s/.git/")
    return own.unionByName(files.filter(c % 4 == 0).select("conv_id", "provider", F.concat(wrong, padded, F.lit(".jsonl")).alias("relative"), "content"))


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """A file system that tasks can write to, and the root's path in it."""
    scheme, _, rest = root.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or root).lstrip("/")
    return fs.FileSystem.from_uri(root)


def _put(root: str, files: DataFrame) -> None:
    """Each task writes the content of its rows as the files that they name; a task that is run again writes the same once more."""

    def write(rows) -> None:
        to, base = _file_system(root)
        for r in rows:
            at = f"{base}/{r['provider']}/{r['relative']}"
            to.create_dir(at.rpartition("/")[0], recursive=True)
            with to.open_output_stream(at) as out:
                out.write(r["content"].encode())

    files.select("provider", "relative", "content").foreachPartition(write)


def _take_away(root: str, files: DataFrame) -> None:
    def remove(rows) -> None:
        to, base = _file_system(root)
        for r in rows:
            at = f"{base}/{r['provider']}/{r['relative']}"
            if to.get_file_info(at).type != fs.FileType.NotFound:
                to.delete_file(at)

    files.select("provider", "relative").foreachPartition(remove)


def _roots(root: str) -> dict[str, list[str]]:
    return {p: [f"{root}/{p}"] for p in ("claude", "codex", "pi")}


_PATH_SQL = """CASE conv_id % 3 WHEN 0 THEN '-w-x/' WHEN 1 THEN '2026/01/rollout-' ELSE 's/' END || lpad(CAST(conv_id AS VARCHAR), 9, '0') || '.jsonl'"""
_PROVIDER_SQL = "CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'pi' END"
_UID_SQL = "CASE conv_id % 3 WHEN 0 THEN 'claude:n' WHEN 1 THEN 'codex:c' ELSE 'pi:p' END || (conv_id % 40)"


@query(f"SELECT DISTINCT {_PROVIDER_SQL} AS provider, {_PATH_SQL} AS relative, FALSE AS likely_subagent, TRUE AS filled FROM conversations")
def discovered_files(spark, d):
    """What discovery finds below the roots of three providers, of which one more does not exist."""
    root = scratch(spark, "tree")
    _put(root, _tree(spark, d))
    found = transcripts.discover(spark, {**_roots(root), "pi": [f"{root}/pi", f"{root}/nowhere"]})
    return found.select("provider", "relative", "likely_subagent", (F.col("size") > 0).alias("filled"))


_CONFIG = Config(chunk_tokens=1_000_000_000)


def _synced(spark, d) -> tuple[Store, str, dict]:
    """(store, root of its files, counts) of a first sync of the files of all conversations."""
    root, store = scratch(spark, "tree"), Store(spark, scratch(spark, "store"))
    _put(root, _tree(spark, d))
    return store, root, asdict(run_sync(spark, store, _roots(root), NOW, _CONFIG, HashingEmbedder(8)))


_SAID_SQL = f"""
    t AS (SELECT {_UID_SQL} AS uid, conv_id, turn, role, text, lag(role || chr(0) || text) OVER (PARTITION BY {_UID_SQL} ORDER BY turn, conv_id) AS before
        FROM conversations WHERE role IN ('user', 'assistant')),
    said AS (SELECT uid, count(*) AS n, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn, conv_id) AS body
        FROM t WHERE before IS NULL OR before <> role || chr(0) || text GROUP BY uid),
    every AS (SELECT {_UID_SQL} AS uid, min(conv_id) AS low, count(DISTINCT conv_id) AS n_paths FROM conversations GROUP BY ALL)"""
_COUNTS = ("discovered", "changed", "indexed", "failed", "deleted_sources", "deleted_sessions", "chunked_sessions", "chunks", "embedded_chunks", "embedding_failures")


def _counts(spark, found: dict) -> DataFrame:
    return spark.createDataFrame([(k, found[k]) for k in _COUNTS], "item string, n long")


@query(f"""
    WITH {_SAID_SQL}, c AS (SELECT count(DISTINCT conv_id) AS files FROM conversations), s AS (SELECT count(*) AS n FROM every), k AS (SELECT count(*) AS n FROM said)
    SELECT unnest(['discovered', 'changed', 'indexed', 'failed', 'deleted_sources', 'deleted_sessions', 'chunked_sessions', 'chunks', 'embedded_chunks', 'embedding_failures']) AS item,
        unnest([files, files, s.n, 0, 0, 0, s.n, k.n, k.n, 0]) AS n FROM c, s, k
""")
def sync_counts(spark, d):
    """What a first sync has counted."""
    return _counts(spark, _synced(spark, d)[2])


@query(f"""
    WITH {_SAID_SQL}, f AS (SELECT DISTINCT conv_id, {_UID_SQL} AS uid, conv_id % 6 = 0 AS gone, conv_id % 3 = 2 OR conv_id % 6 = 1 AS changed FROM conversations),
    u AS (SELECT uid, bool_and(gone) AS lost, bool_or(gone OR changed) AND NOT bool_and(gone) AS again FROM f GROUP BY uid),
    n AS (SELECT count(*) FILTER (WHERE NOT gone) AS found, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE gone) AS gone FROM f),
    m AS (SELECT count(*) FILTER (WHERE again) AS again, count(*) FILTER (WHERE lost) AS lost, count(*) FILTER (WHERE again AND uid IN (SELECT uid FROM said)) AS chunks FROM u),
    e AS (SELECT count(*) AS empty FROM u WHERE NOT again AND NOT lost AND uid NOT IN (SELECT uid FROM said))
    SELECT unnest(['discovered', 'changed', 'indexed', 'failed', 'deleted_sources', 'deleted_sessions', 'chunked_sessions', 'chunks', 'embedded_chunks', 'embedding_failures']) AS item,
        unnest([found, changed, again, 0, gone, lost, again + empty, chunks, chunks, 0]) AS n FROM n, m, e
""")
def sync_changes(spark, d):
    """What a second sync has counted, after half of the claude files went and half of the codex files changed; pi files always count as changed."""
    store, root, _ = _synced(spark, d)
    tree = _tree(spark, d)
    _take_away(root, tree.filter("conv_id % 6 = 0 and provider = 'claude' and relative like '-w-x/%'"))
    _put(root, tree.filter("conv_id % 6 = 1 and provider = 'codex' and relative like '2026/%'").withColumn("content", F.concat("content", F.lit("\n\n"))))
    return _counts(spark, asdict(run_sync(spark, store, _roots(root), NOW, _CONFIG, HashingEmbedder(8))))


@query(f"""
    WITH {_SAID_SQL} SELECT uid, coalesce(n, 0) AS message_count, n_paths, CASE WHEN uid LIKE 'pi:%' THEN '/w/y' ELSE '/w/x' END AS cwd, CASE WHEN uid LIKE 'pi:%' THEN 'y' ELSE 'x' END AS repo,
        CASE WHEN uid LIKE 'pi:%' THEN 'synthesized' ELSE 'native' END AS title_source, CASE WHEN uid NOT LIKE 'pi:%' THEN 'T' || low END AS title, '{NOW}' AS indexed_at
    FROM every LEFT JOIN said USING (uid)
""")
def synced_sessions(spark, d):
    s = _synced(spark, d)[0].read("sessions")
    title = F.when(F.col("title_source") == "native", F.col("title"))
    return s.select("uid", "message_count", F.size("transcript_paths").cast("long").alias("n_paths"), "cwd", "repo", "title_source", title.alias("title"), "indexed_at")


@query(f"WITH {_SAID_SQL} SELECT uid, length(coalesce(body, '')) AS chars, sha256(coalesce(body, '')) AS body_sha FROM every LEFT JOIN said USING (uid)")
def synced_docs(spark, d):
    return _synced(spark, d)[0].read("session_docs").select("uid", F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("body_sha"))


@query(f"SELECT DISTINCT {_UID_SQL} AS uid, {_PATH_SQL} AS relative, '{NOW}' AS first_seen_at FROM conversations")
def synced_sources(spark, d):
    """The manifest with the sessions that each file belongs to."""
    store = _synced(spark, d)[0]
    both = store.read("sources").join(store.read("session_sources"), "path")
    return both.select("uid", F.regexp_extract("path", r"/(?:claude|codex|pi)/(.*)", 1).alias("relative"), "first_seen_at")


@query(rf"""
    WITH {_SAID_SQL} SELECT uid || '#000000' AS chunk_id, sha256(regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '')) AS text_sha256, 'embedded' AS embedding_status, 8 AS width, 1 AS cached FROM said
""")
def synced_chunks(spark, d):
    """Chunks with their vectors and the cache entry that these came from."""
    store = _synced(spark, d)[0]
    cache = store.read("embedding_cache").groupBy("embed_sha256").agg(F.count("*").cast("int").alias("cached"))
    rows = store.read("chunks").join(store.read("chunk_embeddings").drop("uid"), "chunk_id").join(cache, "embed_sha256")
    return rows.select("chunk_id", "text_sha256", "embedding_status", F.size("embedding").alias("width"), "cached")


@query(rf"""
    WITH t AS (SELECT DISTINCT conv_id, {_UID_SQL} AS uid, {_PATH_SQL} AS relative FROM conversations)
    SELECT uid, string_agg('# ' || relative || chr(10) || chr(10) || 'file ' || conv_id, chr(10) || chr(10) ORDER BY relative) AS text FROM t GROUP BY uid
""")
def merged_transcript(spark, d):
    """The files of each session as one text, here with a short content for each."""
    links = _synced(spark, d)[0].read("session_sources").select("uid", F.regexp_extract("path", r"/(?:claude|codex|pi)/(.*)", 1).alias("path"))
    contents = links.select("path", F.concat(F.lit("file "), F.regexp_extract("path", r"0*(\d+)\.jsonl", 1)).alias("content")).distinct()
    return admin.merged_transcripts(contents, links)


# -- tables of a store ----------------------------------------------------------------------------------------------------


def fit(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a table, null where it lacks them."""
    kinds = df.sparkSession.createDataFrame([], TABLES[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def _filled(spark, d) -> Store:
    """A store whose sessions are conversations, each with a file, and whose chunks follow from the labels of documents."""
    store = Store(spark, scratch(spark, "store"))
    admin.migrate(store, NOW)
    s = sessions(spark, d)
    c = F.col("conv_id")
    path = F.concat(F.lit("/f/"), c)
    store.write("sessions", fit(s, "sessions"))
    store.write("session_docs", fit(s, "session_docs"))
    store.write("session_sources", fit(s.select("uid", path.alias("path")), "session_sources"))
    store.write("sources", fit(s.select(path.alias("path"), "provider", F.lit(1).alias("size"), F.col("updated_at").alias("last_seen_at")), "sources"))
    store.write("parse_errors", fit(s.filter(c % 4 == 1).select(path.alias("path"), "provider", F.lit("e").alias("error"), "updated_at"), "parse_errors"))
    status = F.when(c % 3 == 0, "embedded").when(c % 5 == 0, "failed").otherwise("pending")
    chunks = s.select("uid", "provider", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), "body", status.alias("embedding_status"))
    chunks = chunks.withColumn("chunk_id", F.concat("uid", F.lit("#"), "ord"))
    store.write("chunks", fit(chunks, "chunks"))
    store.write("chunk_embeddings", fit(chunks.filter("embedding_status = 'embedded'").withColumn("embedding", F.array(F.lit(1.0))), "chunk_embeddings"))
    return store


# -- kept indexes ----------------------------------------------------------------------------------------------------------

_CHANGED_SQL = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' in front of the sea' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"
_HITS = "SELECT doc AS doc_id, round(bm25, 6) AS bm25, keyword_rank FROM top"


def _hits(spark, index: lexical.Index, phrases: list[str]) -> DataFrame:
    asked = spark.createDataFrame([(0, phrases)], "query int, phrases array<string>")
    index = index.only([w for p in phrases for w in p.split()])
    found = lexical.top_keyword_hits(lexical.bm25(index, lexical.phrase_table(index, asked, F.col("phrases"))))
    return found.select(F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("bm25"), F.col("keyword_rank").cast("long").alias("keyword_rank"))


@query(f"WITH {bm25_sql(['of the', 'in'])} {_HITS}")
def saved_phrases(spark, d):
    """Phrases by the position lists of an index that is written and read again."""
    index = lexical.build_index(table(spark, d, "documents"), "doc_id", {"text": 1.0}, stemmed=False).saved(scratch(spark, "index"))
    return _hits(spark, index, ["of the", "in"])


@query(f"WITH {bm25_sql(['of the', 'sea']).replace('FROM documents', f'FROM {_CHANGED_SQL}')} {_HITS}")
def followed_changes(spark, d):
    """Scores of an index that first held all documents, then followed as a seventh of them went and a fifth changed."""
    docs, c = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    index = SegmentedIndex(spark, scratch(spark, "segments"), {"text": 1.0}, stemmed=False)
    index.refresh(docs, "doc_id")
    longer = F.when(c % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" in front of the sea"))).otherwise(F.col("text"))
    index.refresh(docs.filter(c % 7 != 0).withColumn("text", longer), "doc_id")
    return _hits(spark, index.index(), ["of the", "sea"])


_CONVS = "convs AS (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"WITH {_CONVS} SELECT step, (SELECT count(*) FROM convs) AS sessions FROM (VALUES ('001_init'), ('002_semantic')) v(step)")
def migration_steps(spark, d):
    """The schema steps that run once on a store that has sessions already, which stay; the second time none runs."""
    store = Store(spark, scratch(spark, "store"))
    store.write("sessions", fit(sessions(spark, d), "sessions"))
    ran = [(step,) for _ in range(2) for step in admin.migrate(store, NOW)]
    return spark.createDataFrame(ran, "step string").crossJoin(store.read("sessions").agg(F.count("*").alias("sessions")))


@query(f"""
    WITH {_CONVS} SELECT count(*) AS sessions, 2 * count(*) FILTER (WHERE conv_id % 3 = 0) AS vectors, count(*) FILTER (WHERE conv_id % 4 = 1) AS parse_errors, 2 * count(*) AS total,
        2 * count(*) FILTER (WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0) AS pending, 2 * count(*) FILTER (WHERE conv_id % 3 = 0) AS embedded,
        2 * count(*) FILTER (WHERE conv_id % 3 <> 0 AND conv_id % 5 = 0) AS failed FROM convs
""")
def store_status(spark, d):
    return _filled(spark, d).status()


@query(f"""
    WITH {_CONVS} SELECT unnest(['sessions', 'vectors', 'pending', 'embeddings', 'semantic', 'migrations']) AS item,
        unnest([CAST(count(*) AS VARCHAR), CAST(2 * count(*) FILTER (WHERE conv_id % 3 = 0) AS VARCHAR), CAST(2 * count(*) FILTER (WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0) AS VARCHAR),
            'local Ollama', 'keyword only', '001_init,002_semantic']) AS value FROM convs
""")
def doctor_report(spark, d):
    from threadloom.config import Embeddings  # noqa: PLC0415

    made = admin.report(_filled(spark, d), Config(embeddings=Embeddings("ollama")))
    return made.filter(F.col("item").isin("sessions", "vectors", "pending", "embeddings", "semantic", "migrations"))


def _left(store: Store) -> DataFrame:
    """How many rows of which provider each table has."""
    by_uid = [store.read(t).select(F.lit(t).alias("name"), F.substring_index("uid", ":", 1).alias("provider")) for t in ("sessions", "session_docs", "session_sources", "chunks", "chunk_embeddings")]
    own = [store.read(t).select(F.lit(t).alias("name"), "provider") for t in ("sources", "parse_errors")]
    every = by_uid[0]
    for one in (*by_uid[1:], *own):
        every = every.unionByName(one)
    return every.groupBy("name", "provider").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_CONVS}, p AS (SELECT conv_id, {_PROVIDER_SQL} AS provider FROM convs WHERE conv_id % 3 <> 1)
    SELECT * FROM (SELECT unnest(['sessions', 'session_docs', 'session_sources', 'sources', 'chunks', 'chunk_embeddings', 'parse_errors']) AS name, provider,
        unnest([count(*), count(*), count(*), count(*), 2 * count(*), 2 * count(*) FILTER (WHERE conv_id % 3 = 0), count(*) FILTER (WHERE conv_id % 4 = 1)]) AS n FROM p GROUP BY provider) WHERE n > 0
""")
def provider_clearing(spark, d):
    """What is left when everything that came from codex has been forgotten."""
    store = _filled(spark, d)
    store.clear("codex")
    return _left(store)


@query(f"WITH {SESSIONS_SQL} SELECT '/f/' || conv_id AS path, updated_at, row_number() OVER (ORDER BY updated_at DESC, '/f/' || conv_id) AS place FROM sessions QUALIFY place <= 20")
def recent_sources(spark, d):
    latest = _filled(spark, d).recent_sources(20)
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), "path")).cast("long")
    return latest.select("path", F.col("last_seen_at").alias("updated_at")).withColumn("place", place)


@query(f"WITH {SESSIONS_SQL} SELECT '/f/' || conv_id AS path, error, updated_at FROM (SELECT *, 'e' AS error FROM sessions WHERE conv_id % 4 = 1) ORDER BY updated_at DESC, path LIMIT 7")
def recent_errors(spark, d):
    return _filled(spark, d).recent_errors(7).select("path", "error", "updated_at")


@query(f"""
    WITH {SESSIONS_SQL}, old AS (SELECT {"provider || ':' || native_id"} AS uid, conv_id FROM sessions)
    SELECT uid, '/f/' || conv_id AS path FROM old WHERE conv_id % 2 = 1
    UNION ALL SELECT uid, '/f/' || other FROM (SELECT uid, conv_id + 1 AS other FROM old WHERE conv_id % 2 = 0) WHERE other IN (SELECT conv_id FROM sessions)
""")
def relinked_sources(spark, d):
    """Links of every second session replaced by the file of the next one, where the manifest knows it."""
    store = _filled(spark, d)
    links = sessions(spark, d).filter("conv_id % 2 = 0").select("uid", F.concat(F.lit("/f/"), F.col("conv_id") + 1).alias("path"))
    return admin.relink(store, links)


@query(f"WITH {SESSIONS_SQL} SELECT {"provider || ':' || native_id"} AS uid, body, message_count FROM sessions WHERE conv_id = (SELECT min(conv_id) FROM sessions)")
def session_by_uid(spark, d):
    first = sessions(spark, d).agg(F.min_by("uid", "conv_id").alias("uid")).first()["uid"]
    return admin.session(_filled(spark, d), first).select("uid", "body", "message_count")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS made, part FROM documents, (VALUES (0), (1), (2)) p(part) WHERE doc_id % 4 <> 0 OR (part = 0 AND doc_id % 8 = 0)")
def chunk_replacement(spark, d):
    """Chunks of every fourth document replaced: by one chunk for half of these, by none for the others."""
    docs = table(spark, d, "documents").select("doc_id")
    old = docs.select("doc_id", F.lit("old").alias("made"), F.explode(F.array(*map(F.lit, range(3)))).alias("part"))
    gone = docs.filter("doc_id % 4 = 0")
    new = gone.filter("doc_id % 8 = 0").select("doc_id", F.lit("new").alias("made"), F.lit(0).alias("part"))
    return tables.replace_group(old, new, ["doc_id"], gone=gone)


@query("SELECT doc_id, source FROM documents WHERE doc_id % 9 <> 0")
def deleted_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return tables.delete_keys(docs, docs.filter("doc_id % 9 = 0"), ["doc_id"])


@query("""
    SELECT doc_id, source AS updated_at, row_number() OVER (ORDER BY source DESC, doc_id DESC) AS place FROM documents
    WHERE doc_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) QUALIFY place <= 50
""")
def needs_chunks_order(spark, d):
    """The latest of the sessions without chunks of the current version, as far as a backfill goes."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 3 == 0, "v0").otherwise("v1").alias("chunk_version"), F.col("source").alias("updated_at"))
    found = tables.needs_chunks(s, table(spark, d, "labels").select(F.col("doc_id").alias("uid")), "v1", 50)
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("uid"))).cast("long")
    return found.select(F.col("uid").alias("doc_id"), "updated_at", place.alias("place"))


@query("SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS renewed, len(embedding) AS width FROM embeddings")
def embedding_cache_put(spark, d):
    """Cached vectors, of which every second is put again."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.lit(0).alias("renewed"))
    again = e.filter("vec_id % 2 = 0").withColumn("renewed", F.lit(1))
    return tables.upsert(e, again, ["vec_id"]).select("vec_id", "label", "renewed", F.size("embedding").cast("long").alias("width"))
