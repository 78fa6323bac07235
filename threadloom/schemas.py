"""Table schemas and the values of enumerated columns."""

from __future__ import annotations

PROVIDERS = ("claude", "codex", "pi")
SURFACES = ("cli", "ide", "desktop", "subagent", "cloud")
TITLE_SOURCES = ("native", "synthesized")
EMBEDDING_STATUSES = ("pending", "embedded", "failed")
SNIPPET_SOURCES = ("fts", "vector", "body")
UNKNOWN_CWD = "(unknown)"
NORMALIZE_VERSION = "fts-foundation-v1"
CHUNK_VERSION = "semantic-chunks-v1"

TURN = "struct<role:string,text:string,timestamp:string,model:string>"

#: One row per transcript file.
PARSED = (
    "provider string, native_id string, path string, cwd string, branch string, surface string, title string, first_prompt string, "
    "created_at string, updated_at string, models array<string>, is_subagent boolean, "
    f"turns array<{TURN}>, raw_bytes long, warnings array<string>"
)

TABLES = {
    "sources": "path string, provider string, size long, mtime_ms double, sha256 string, first_seen_at string, last_seen_at string, last_error string",
    "sessions": (
        "uid string, provider string, native_id string, surface string, cwd string, repo string, branch string, title string, title_source string, "
        "first_prompt string, created_at string, updated_at string, message_count long, models array<string>, is_subagent boolean, "
        "transcript_paths array<string>, resume_cmd string, fork_cmd string, bytes long, body_sha256 string, normalize_version string, "
        "chunk_version string, indexed_at string"
    ),
    "session_docs": "uid string, title string, first_prompt string, body string",
    "session_sources": "uid string, path string",
    "parse_errors": "path string, provider string, error string, updated_at string",
    "chunks": (
        "chunk_id string, uid string, ord int, text string, approx_tokens int, start_char int, end_char int, text_sha256 string, embed_sha256 string, "
        "info_score double, embedding_status string, embedding_error string, embedded_at string"
    ),
    "embedding_cache": "embed_sha256 string, model string, dimensions int, vector array<float>",
    "query_embedding_cache": "query_sha256 string, model string, dimensions int, vector array<float>",
    "chunk_embeddings": "chunk_id string, uid string, embedding array<float>",
    "index_meta": "key string, value string",
}

#: The column that a table's buckets go by, where it isn't ``uid``.
BUCKET_KEYS = {
    "sources": "path",
    "parse_errors": "path",
    "embedding_cache": "embed_sha256",
    "query_embedding_cache": "query_sha256",
    "index_meta": "key",
}
