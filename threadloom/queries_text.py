"""Registered queries of parsing, cleaning, the query language, chunk windows and whole searches, each with the SQL that says the same."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import textops
from threadloom.operators import chunks, lexical, ranking, snippets
from threadloom.plans import search as searching
from threadloom.plans.query import TextPlan, parse_query
from threadloom.queries import _NEAR_SQL, _SHARED_SQL, _TAG_RULES, NOW, SESSIONS_SQL, _nested_sql, query, sessions, table
from threadloom.sources import transcripts

# -- transcripts of the other providers ---------------------------------------------------------------------------------

_STAMP = "'2026-01-01T00:00:0' || turn || 'Z'"


def _stamp() -> Column:
    return F.concat(F.lit("2026-01-01T00:00:0"), F.col("turn"), F.lit("Z"))


def _lines(*lines: Column) -> Column:
    """The lines of each turn, in order, as one text."""
    made = F.array_join(F.array(*lines), "\n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", made.alias("line")))), lambda x: x["line"])
    return F.concat(F.array_join(ordered, "\n"), F.lit("\n"))


def _of(kind: str, payload: Column, name: str = "payload") -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), _stamp().alias("timestamp"), payload.alias(name)))


def _message(part: str) -> Column:
    content = F.array(F.struct(F.lit(part).alias("type"), F.col("text").alias("text")))
    return F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), content.alias("content"))


def codex_files(spark, d) -> DataFrame:
    c = F.col("conv_id")
    meta = F.struct(
        F.concat(F.lit("c"), c % 40).alias("id"),
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"),
        F.lit("/w/x").alias("cwd"),
        F.when(c % 3 == 0, "vscode").otherwise("cli").alias("source"),
        F.when(c % 5 == 0, "subagent").alias("thread_source"),
        F.concat(F.lit("T"), c).alias("thread_name"),
    )
    model = F.struct(F.concat(F.lit("m"), c % 3).alias("model"))
    head = F.when(F.col("turn") == 0, F.array(_of("session_meta", meta), _of("turn_context", model))).otherwise(F.array())
    both = F.array_join(F.concat(head, F.array(_of("response_item", _message("input_text")))), "\n")
    files = table(spark, d, "conversations").groupBy("conv_id").agg(_lines(both).alias("content"), F.count("*").alias("size"))
    return files.select(F.lit("codex").alias("provider"), F.concat(F.lit("/r/rollout-"), c, F.lit(".jsonl")).alias("path"), "size", "content")


def pi_files(spark, d) -> DataFrame:
    c = F.col("conv_id")
    start = F.to_json(F.struct(F.lit("session").alias("type"), _stamp().alias("timestamp"), F.concat(F.lit("p"), c % 40).alias("id"), F.lit("/w/y").alias("cwd")))
    change = F.to_json(F.struct(F.lit("model_change").alias("type"), F.concat(F.lit("m"), F.col("turn")).alias("modelId")))
    lines = F.concat(
        F.when(F.col("turn") == 0, F.array(start)).otherwise(F.array()),
        F.when(F.col("turn") % 3 == 0, F.array(change)).otherwise(F.array()),
        F.array(_of("message", _message("text"), "message")),
    )
    files = table(spark, d, "conversations").groupBy("conv_id").agg(_lines(F.array_join(lines, "\n")).alias("content"), F.count("*").alias("size"))
    return files.select(F.lit("pi").alias("provider"), F.concat(F.lit("/r/"), c, F.lit(".jsonl")).alias("path"), "size", "content")


@query(f"""
    SELECT '/r/rollout-' || conv_id || '.jsonl' AS path, 'c' || (conv_id % 40) AS native_id, '/w/x' AS cwd, 'T' || conv_id AS title, conv_id % 5 = 0 AS is_subagent,
        CASE WHEN conv_id % 5 = 0 THEN 'subagent' WHEN conv_id % 3 = 0 THEN 'ide' ELSE 'cli' END AS surface, 'm' || (conv_id % 3) AS models,
        min({_STAMP}) AS created_at, max({_STAMP}) AS updated_at, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n_turns
    FROM conversations GROUP BY conv_id
""")
def codex_parse(spark, d):
    parsed, _ = transcripts.parse_files(codex_files(spark, d))
    return parsed.select(
        "path", "native_id", "cwd", "title", "is_subagent", "surface", F.array_join("models", ",").alias("models"), "created_at", "updated_at", F.size("turns").cast("long").alias("n_turns")
    )


@query("""
    SELECT '/r/' || conv_id || '.jsonl' AS path, 'p' || (conv_id % 40) AS native_id, '/w/y' AS cwd,
        array_to_string(list_sort(list('m' || turn) FILTER (WHERE turn % 3 = 0)), ',') AS models,
        coalesce(string_agg('m' || (turn - turn % 3), ',' ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')), '') AS turn_models
    FROM conversations GROUP BY conv_id
""")
def pi_parse(spark, d):
    parsed, _ = transcripts.parse_files(pi_files(spark, d))
    by_turn = F.array_join(F.transform("turns", lambda t: t["model"]), ",")
    return parsed.select("path", "native_id", "cwd", F.array_join("models", ",").alias("models"), by_turn.alias("turn_models"))


@query("""
    SELECT CASE WHEN conv_id % 2 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') ELSE 'file' || conv_id END AS native_id,
        CASE WHEN conv_id % 7 = 0 THEN '/w/agent/view' ELSE '/home/me/.p' || (conv_id % 5) END AS cwd, conv_id % 7 = 0 AS is_subagent,
        CASE WHEN conv_id % 7 = 0 THEN 'subagent' ELSE 'cli' END AS surface
    FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def transcript_fallbacks(spark, d):
    """Files whose records say neither session nor directory: the path does."""
    c = F.col("conv_id")
    name = F.when(c % 2 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))).otherwise(F.concat(F.lit("file"), c))
    folder = F.when(c % 7 == 0, "-w-agent-view").otherwise(F.concat(F.lit("-home-me--p"), c % 5))
    files = table(spark, d, "conversations").select("conv_id").distinct().select(
        F.lit("claude").alias("provider"), F.concat(F.lit("/r/"), folder, F.lit("/"), name, F.lit(".jsonl")).alias("path"), F.lit(9).cast("long").alias("size"), F.lit('{"type":"summary"}\n').alias("content")
    )
    parsed, _ = transcripts.parse_files(files)
    return parsed.select("native_id", "cwd", "is_subagent", "surface")


@query("""
    SELECT conv_id, to_json({'type': 'message', 'role': role, 'content': [{'type': 'input_text', 'text': text}]}) AS payload FROM conversations WHERE turn = 0
""")
def first_record(spark, d):
    """The first record of each file; of a codex file without its head that is the first message."""
    from threadloom.plans.admin import first_records  # noqa: PLC0415

    files = table(spark, d, "conversations").groupBy("conv_id").agg(_lines(_of("response_item", _message("input_text"))).alias("content"))
    lines = transcripts.json_lines(files.select(F.lit("codex").alias("provider"), F.col("conv_id").cast("string").alias("path"), "content"))
    return first_records(lines).select(F.col("path").cast("long").alias("conv_id"), F.get_json_object("raw", "$.payload").alias("payload"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ['ide', 'desktop', 'subagent', 'cloud', 'cli', 'ide'][doc_id % 6 + 1] END AS surface FROM documents
""")
def inferred_surface(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("VSCode", "claude-desktop", "Subagent", "a cloud", "sh", "My IDE"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", transcripts.infer_surface(F.when(F.col("doc_id") % 11 != 0, word)).alias("surface"))


_ENTRIES = ("a/b.jsonl", "a/.git/b.jsonl", "node_modules/x.jsonl", "a/b.jsonl.tmp", "a/.DS_Store", "a/b~", "a/c.swp", "x.lock", "lock/tmp.jsonl")


@query(f"SELECT doc_id, doc_id % {len(_ENTRIES)} IN (0, 8) AS kept FROM documents")
def kept_entries(spark, d):
    path = F.element_at(F.array(*map(F.lit, _ENTRIES)), (F.col("doc_id") % len(_ENTRIES) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", transcripts.kept_entry(path).alias("kept"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2026-03-01T00:00:0' || (event_id % 10) || 'Z' WHEN 1 THEN strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS ts FROM events
""")
def iso_timestamps(spark, d):
    """Times as texts, as milliseconds, as something else, and missing ones."""
    i = F.col("event_id")
    said = F.when(i % 4 == 0, F.concat(F.lit('{"t": "2026-03-01T00:00:0'), i % 10, F.lit('Z"}'))).when(i % 4 == 1, F.concat(F.lit('{"t": '), i * 1000, F.lit("}")))
    value = F.parse_json(F.coalesce(said, F.when(i % 4 == 2, F.lit('{"t": "soon"}')).otherwise("{}")))
    return table(spark, d, "events").select("event_id", transcripts.iso_timestamp(value, "$.t").alias("ts"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'app' || (doc_id % 3) WHEN 1 THEN 'app' || (doc_id % 3) WHEN 2 THEN 'loose' END AS repo FROM documents")
def enclosing_repos(spark, d):
    """The name of the folder around a path that holds a repository, where there is one."""
    from threadloom.operators.sessions import enclosing_repo  # noqa: PLC0415
    from threadloom.schemas import UNKNOWN_CWD  # noqa: PLC0415

    app = F.concat(F.lit("/w/app"), F.col("doc_id") % 3)
    cwd = F.when(F.col("doc_id") % 4 == 0, app).when(F.col("doc_id") % 4 == 1, F.concat(app, F.lit("/src/deep"))).when(F.col("doc_id") % 4 == 2, "/tmp/loose").otherwise(UNKNOWN_CWD)
    known = frozenset(f"/w/app{n}/.git" for n in range(3))
    return table(spark, d, "documents").select("doc_id", enclosing_repo(known.__contains__)(cwd).alias("repo"))


# -- text -----------------------------------------------------------------------------------------------------------

_CLEAN_FIRST = [(r"\x1B\[[0-9;]*m", "", "g"), *_TAG_RULES[:-2], (r"(?is)\A(.*?)(?m:^)# AGENTS\.md instructions.*?</INSTRUCTIONS>", r"\1 ", ""), _TAG_RULES[-2]]
_CODEX_RULES = [(r"(?i)# AGENTS\.md instructions for [^\n]*\n(\n)", r" \n\1", "g"), (r"(?is)\A# In app browser:.*?## My request for Codex:\s*", "", ""), (r"(?is)\AIn app browser:.*?My request for Codex:\s*", "", "")]
_SPACE_RULES = [(r"\r\n?", "' || chr(10) || '", "g"), (r"[\t\f\x0B]+", " ", "g"), (r"\n{3,}", "' || chr(10) || chr(10) || '", "g"), ("(?m)[ \\t]+$", "", "g"), (r"^\s+", "", ""), (r"\s+$", "", "")]
_PREAMBLE = "# In app browser: x\n## My request for Codex: "
_ADDED = "\x1b[31mred\x1b[0m <a href=x>\n<environment_context>gone</environment_context>\n# AGENTS.md instructions\nmore\n</INSTRUCTIONS> end\n"
_PREAMBLE_SQL, _ADDED_SQL = ("'" + x.replace("\n", "' || chr(10) || '").replace("\x1b", "' || chr(27) || '") + "'" for x in (_PREAMBLE, _ADDED))


@query(rf"""
    WITH s AS (SELECT doc_id, doc_id % 2 = 0 AS codex, {_PREAMBLE_SQL} || text || chr(10) || {_ADDED_SQL} AS t FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, codex, {_nested_sql('t', _CLEAN_FIRST)} AS t FROM s),
    b AS (SELECT doc_id, regexp_replace(CASE WHEN codex THEN {_nested_sql('t', _CODEX_RULES[1:])} ELSE t END, '<[^>]+>', ' ', 'g') AS t FROM a),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM b),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS island FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, island ORDER BY n) AS again FROM g),
    j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM k WHERE again <= 3 GROUP BY doc_id)
    SELECT doc_id, sha256({_nested_sql('t', _SPACE_RULES)}) AS sha FROM j
""")
def conversation_clean(spark, d):
    """Whole cleaning, with a preamble, escape codes, tagged blocks and instructions around each text."""
    docs = table(spark, d, "documents").filter("text is not null")
    text = F.concat(F.lit(_PREAMBLE), F.col("text"), F.lit("\n"), F.lit(_ADDED))
    provider = F.when(F.col("doc_id") % 2 == 0, "codex").otherwise("claude")
    return docs.select("doc_id", F.sha2(textops.clean_text(text, provider), 256).alias("sha"))


@query("""
    SELECT doc_id, sha256('task: search result | query: ' || text) AS gemma_query, sha256('title: none | text: ' || text) AS gemma_document,
        sha256('Instruct: Retrieve relevant documents for the given query' || chr(10) || 'Query: ' || text) AS qwen_query, sha256(text) AS voyage FROM documents
""")
def embedding_prefix(spark, d):
    def sha(kind: str, model: str, name: str) -> Column:
        return F.sha2(textops.embedding_text(F.col("text"), kind, model), 256).alias(name)

    return table(spark, d, "documents").select(
        "doc_id", sha("query", "embeddinggemma", "gemma_query"), sha("document", "nomic-x", "gemma_document"), sha("query", "Qwen3-Embedding", "qwen_query"), sha("document", "voyage-code-3", "voyage")
    )


_WS_SQL = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query(rf"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[{_WS_SQL}]+', ''), '[{_WS_SQL}]+$', '') AS t FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[^{_WS_SQL}]+') AS w, regexp_extract_all(t, '[^{_WS_SQL}]+[{_WS_SQL}]*') AS ws FROM t),
    n AS (SELECT doc_id, t, len(w) AS n, list_transform(ws, lambda x: length(x)) AS step, list_transform(w, lambda x: length(x)) AS size,
        list_transform(w, lambda x: greatest(1, CAST(ceil(greatest(len(regexp_extract_all(x, '[\p{{L}}\p{{N}}_-]+|[^{_WS_SQL}]')), length(x) / 4)) AS BIGINT))) AS tok FROM u WHERE len(w) > 0),
    flat AS (SELECT doc_id, unnest(tok) AS tok, unnest(step) AS step, unnest(size) AS size, generate_subscripts(tok, 1) - 1 AS i FROM n),
    sums AS (SELECT doc_id, i, tok, step, sum(tok) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(step) OVER (PARTITION BY doc_id ORDER BY i) - step AS start FROM flat),
    doc AS (SELECT s.doc_id, list(upto ORDER BY i) AS upto, list(start ORDER BY i) AS start, count(*) AS n FROM sums s GROUP BY s.doc_id),
    win(doc_id, ord, first, last) AS (
        SELECT doc_id, 0, 0, least(n, len(list_filter(upto, lambda x: x < 512)) + 1) FROM doc
        UNION ALL
        SELECT doc_id, ord, first, least(n, len(list_filter(upto, lambda x: x < 512 + (CASE WHEN first = 0 THEN 0 ELSE upto[first] END))) + 1) FROM (
            SELECT d.doc_id, w.ord + 1 AS ord, d.upto, d.n, greatest(w.first + 1, greatest(1, len(list_filter(d.upto, lambda x: x <= d.upto[w.last] - 96)))) AS first
            FROM win w JOIN doc d USING (doc_id) WHERE w.last < d.n))
    SELECT w.doc_id, w.ord, CAST(upto[w.last] - (CASE WHEN w.first = 0 THEN 0 ELSE upto[w.first] END) AS BIGINT) AS approx_tokens, CAST(start[w.first + 1] AS BIGINT) AS start_char,
        sha256(regexp_replace(substr(t, CAST(start[w.first + 1] AS BIGINT) + 1, CAST((CASE WHEN w.last = d.n THEN length(t) ELSE start[w.last + 1] END) - start[w.first + 1] AS BIGINT)), '[{_WS_SQL}]+$', '')) AS text_sha256
    FROM win w JOIN doc d USING (doc_id) JOIN n USING (doc_id)
""")
def chunk_spans(spark, d):
    """All windows of every document, before their number is capped."""
    made = chunks.chunk_documents(table(spark, d, "documents"), "doc_id", "text", most=1_000_000_000)
    return made.select(F.col("uid").alias("doc_id"), "ord", F.col("approx_tokens").cast("long").alias("approx_tokens"), F.col("start_char").cast("long").alias("start_char"), "text_sha256")


@query("SELECT doc_id, 'base:' || source || ':' || 768 || ':redact' AS redacting, 'base:' || source || ':' || 768 || ':raw' AS plain FROM documents WHERE source IS NOT NULL")
def chunk_versions(spark, d):
    """The version of chunks for each source taken as a model."""

    @F.pandas_udf(T.StringType())
    def version(models: pd.Series, redact: pd.Series) -> pd.Series:
        return pd.Series([chunks.chunk_version("base", m, 768, r) for m, r in zip(models, redact, strict=True)], dtype=object)

    docs = table(spark, d, "documents").filter("source is not null")
    return docs.select("doc_id", version("source", F.lit(True)).alias("redacting"), version("source", F.lit(False)).alias("plain"))


# -- the query language -------------------------------------------------------------------------------------------------


def _asked(spark, d) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", words.alias("w")).filter("size(w) >= 4")


_ASKED_SQL = "asked AS (SELECT item_id, w FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) WHERE len(w) >= 4)"


@query(f"""
    WITH {_ASKED_SQL} SELECT item_id,
        (CASE WHEN item_id % 2 = 0 THEN 'provider:codex ' ELSE '' END) || 'repo:my r' || item_id || ' since:2026-01-' || lpad(CAST(item_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z until:2026-04-08T00:00:00.000Z'
            || (CASE WHEN item_id % 3 = 0 THEN ' include:subagents' ELSE '' END) AS filters,
        '"' || w[1] || ' repo:no ' || w[2] || '" bogus:x ' || (CASE WHEN item_id % 2 = 1 THEN 'provider:nope ' ELSE '' END) || w[3] AS free_text,
        CAST(item_id % 2 AS BIGINT) AS warnings
    FROM asked
""")
def parsed_queries(spark, d):
    """Filters, free text and the number of warnings of a query made from each benchmark item."""

    @F.pandas_udf("filters string, free_text string, warnings long")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        found = [parse_query(q, NOW) for q in raw]
        return pd.DataFrame({"filters": [" ".join(p.filters.active()) for p in found], "free_text": [p.free_text for p in found], "warnings": [len(p.warnings) for p in found]})

    c, w = F.col("item_id"), F.col("w")
    raw = F.concat(
        F.lit('repo:"my r'), c, F.lit('"  "'), w[0], F.lit(" repo:no "), w[1], F.lit('" since:2026-01-'), F.lpad((c % 28 + 1).cast("string"), 2, "0"),
        F.lit(" bogus:x until:1w provider:"), F.when(c % 2 == 0, "codex ").otherwise("nope "), F.when(c % 3 == 0, "include:subagents ").otherwise(""), w[2], F.lit("  "),
    )
    return _asked(spark, d).select("item_id", parsed(raw).alias("p")).select("item_id", "p.*")


@query(f"""
    WITH {_ASKED_SQL} SELECT item_id, w[1] || ' ' || w[2] || '|' || w[3] || '|src/' || w[4] || '.ts|ABC_D|x1' AS tokens, 'src/' || w[4] || '.ts|ABC_D|x1' AS exactish,
        '"' || w[1] || ' ' || w[2] || '" AND "' || w[3] || '" AND "src/' || w[4] || '.ts" AND "ABC_D" AND "x1"' AS expression FROM asked
""")
def query_plans(spark, d):
    """Tokens, exact-ish terms and the full-text expression of a query made from each benchmark item."""

    @F.pandas_udf("tokens string, exactish string, expression string")
    def planned(raw: pd.Series) -> pd.DataFrame:
        plans = [TextPlan.of(q) for q in raw]
        return pd.DataFrame({"tokens": ["|".join(p.tokens) for p in plans], "exactish": ["|".join(p.exactish) for p in plans], "expression": [p.expression for p in plans]})

    w = F.col("w")
    raw = F.concat(F.lit(' "'), w[0], F.lit(" "), w[1], F.lit('"   '), w[2], F.lit(" src/"), w[3], F.lit(".ts ABC_D  x1 "))
    return _asked(spark, d).select("item_id", planned(raw).alias("p")).select("item_id", "p.*")


# -- scores and excerpts ------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE round(1 / (1 + greatest(0, (event_id - 100) / 8)), 9) END AS score FROM events")
def keyword_scores(spark, d):
    raw = F.when(F.col("event_id") % 50 == 0, float("inf")).otherwise((F.col("event_id") - 100) / 8)
    return table(spark, d, "events").select("event_id", F.round(lexical.keyword_score(raw), 9).alias("score"))


@query(rf"""
    WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, t, CASE WHEN doc_id % 5 = 0 AND t <> '' THEN 'body' WHEN doc_id % 3 = 0 AND doc_id % 40 <= doc_id % 17 + 10 THEN 'fts'
        WHEN doc_id % 2 = 0 AND t <> '' THEN 'vector' ELSE 'body' END AS snippet_source FROM n),
    x AS (SELECT doc_id, snippet_source, CASE WHEN snippet_source = 'fts' THEN trim('f ' || t) ELSE t END AS x FROM c)
    SELECT doc_id, snippet_source, CASE WHEN length(x) > 220 THEN rtrim(substr(x, 1, 219)) || '{snippets.MORE}' ELSE x END AS snippet FROM x
""")
def snippet_choice(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").filter("text is not null").select(
        "doc_id",
        F.when(i % 5 == 0, F.col("text")).alias("preview_snippet"),
        F.when(i % 3 == 0, F.concat(F.lit("f "), F.col("text"))).alias("fts_snippet"),
        (i % 40).alias("keyword_rank"),
        (i % 17).alias("vector_rank"),
        F.when(i % 2 == 0, F.col("text")).alias("semantic_snippet"),
        F.col("text").alias("body"),
    )
    snippet, source = snippets.choose(rows.columns, "")
    return rows.select("doc_id", source.alias("snippet_source"), snippet.alias("snippet"))


# -- whole searches -----------------------------------------------------------------------------------------------------


def corpus(spark, d) -> searching.Corpus:
    by = F.col("provider"), F.col("native_id"), F.col("cwd")
    s = sessions(spark, d).withColumns(
        {
            "created_at": F.col("updated_at"),
            "models": F.array().cast("array<string>"),
            "resume_cmd": textops.resume_command(*by),
            "fork_cmd": textops.fork_command(*by),
        }
    )
    return searching.Corpus.of(s.drop("body"), s.select("uid", "title", "first_prompt", "body"), stemmed=False)


#: Searches order by scores of four decimals here, as their SQL does.
_HERE = searching.Context(NOW, "repo2", "/work/Repo3", ranking.Weights(recency_digits=6, score_digits=4))
_UID = "provider || ':' || native_id"


def _browse_sql(condition: str, limit: int, candidates: int) -> str:
    return f"""
        l AS (SELECT * FROM sessions {condition} ORDER BY updated_at DESC, {_UID} DESC LIMIT {candidates}),
        p AS (SELECT updated_at, {_UID} AS uid, title, provider, body, {_SHARED_SQL} FROM l),
        o AS (SELECT row_number() OVER (ORDER BY recency_boost + repo_boost + cwd_boost - short_penalty - subagent_penalty - missing_cwd_penalty DESC, updated_at DESC, uid) AS position, * FROM p QUALIFY position <= {limit})"""


@query(f"WITH {SESSIONS_SQL}, {_browse_sql('WHERE NOT is_subagent', 30, 30)} SELECT position, uid, title FROM o")
def recent_sessions(spark, d):
    return searching.recent(corpus(spark, d), 30, _HERE).select(F.col("position").cast("long").alias("position"), "uid", "title")


@query(f"WITH {SESSIONS_SQL}, {_browse_sql('', 1000, 500)} SELECT row_number() OVER (ORDER BY position) AS position, uid FROM o WHERE provider = 'codex' QUALIFY row_number() OVER (ORDER BY position) <= 15")
def browse_filtered(spark, d):
    """A query of filters alone: the latest 500 sessions, those that meet the filters by their scores."""
    found = searching.search(corpus(spark, d), "provider:codex include:subagents", _HERE, 15)
    return found.select(F.col("position").cast("long").alias("position"), "uid")


_SEARCH_SQL = rf"""
    {SESSIONS_SQL},
    f AS (SELECT conv_id, 5.0 AS w, title AS x FROM sessions UNION ALL SELECT conv_id, 2.5, first_prompt FROM sessions UNION ALL SELECT conv_id, 1.0, body FROM sessions),
    k AS (SELECT conv_id, w, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS t FROM f),
    n AS (SELECT conv_id, sum(len(t)) AS d FROM k GROUP BY conv_id), a AS (SELECT count(*) AS n_docs, avg(d) AS avg_tokens FROM n),
    h AS (SELECT conv_id, q.term, sum(w * len(list_filter(t, lambda y: y = q.term))) AS f FROM k, (VALUES ('the'), ('in')) q(term) GROUP BY conv_id, q.term HAVING f > 0),
    i AS (SELECT term, greatest(1e-6, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM h, a GROUP BY term, n_docs),
    b AS (SELECT conv_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_tokens))) AS bm25 FROM h JOIN i USING (term) JOIN n USING (conv_id), a GROUP BY conv_id HAVING count(*) = 2),
    r AS (SELECT s.*, row_number() OVER (ORDER BY bm25, {_UID}) AS rank FROM b JOIN sessions s USING (conv_id) QUALIFY rank <= 100),
    p AS (SELECT {_UID} AS uid, updated_at, rank, repo, provider, is_subagent, lower(title) AS lt, {_SHARED_SQL} FROM r)"""


def _placed_sql(condition: str, repo_counts: bool, limit: int) -> str:
    score = f"""round(1 / (60 + rank) + recency_boost{' + repo_boost' if repo_counts else ''} + cwd_boost - short_penalty - subagent_penalty - missing_cwd_penalty
        + CASE WHEN contains(lt, 'the in') THEN 0.12 ELSE 0 END + CASE WHEN contains(lt, 'the') AND contains(lt, 'in') THEN 0.08 ELSE 0 END, 4)"""
    return f"""
        SELECT row_number() OVER (ORDER BY score DESC, contains(lt, 'the in') DESC, updated_at DESC, rank, uid) AS position, uid, score FROM (SELECT *, {score} AS score FROM p WHERE {condition})
        QUALIFY position <= {limit}"""


def _places(found: DataFrame) -> DataFrame:
    return found.select(F.col("position").cast("long").alias("position"), "uid", F.round("score", 4).alias("score"))


@query(f"WITH {_SEARCH_SQL} {_placed_sql('NOT is_subagent', True, 20)}")
def search_sessions(spark, d):
    """A whole keyword search over titles, prompts and bodies."""
    return _places(searching.search(corpus(spark, d), "the in", _HERE, 20))


@query(f"WITH {_SEARCH_SQL} {_placed_sql("repo = 'repo2'", False, 200)}")
def search_filtered(spark, d):
    """The same with filters in the query, applied to the candidates; a repository that is asked for gives no boost."""
    return _places(searching.search(corpus(spark, d), "repo:repo2 the include:subagents in", _HERE))


@query(f"""
    WITH {_NEAR_SQL}, best AS (SELECT 'l' || label AS uid, min(distance) AS distance, arg_min(vec_id, vector_rank) AS vec_id FROM top GROUP BY label)
    SELECT uid, 'text ' || vec_id AS semantic_snippet, row_number() OVER (ORDER BY distance, uid) AS vector_rank, round(1 / (1 + distance), 5) AS vector_score FROM best QUALIFY vector_rank <= 100
""")
def vector_sessions(spark, d):
    """The nearest sessions of a query's vector, with the text of their nearest chunk."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("l"), "label").alias("uid"), "embedding", F.concat(F.lit("text "), "vec_id").alias("text"))
    asked = e.filter("chunk_id = 0").select("embedding").first()["embedding"]
    found = searching.vector_hits(replace(corpus(spark, d), chunk_vectors=e), list(asked))
    return found.select("uid", "semantic_snippet", F.col("vector_rank").cast("long").alias("vector_rank"), F.round("vector_score", 5).alias("vector_score"))


@query(f"""
    WITH {SESSIONS_SQL}, {_browse_sql('WHERE NOT is_subagent', 30, 30)} SELECT position, json_extract_string(j, '$.uid') AS uid, json_extract_string(j, '$.provider') AS provider
    FROM (SELECT position, json_object('uid', uid, 'provider', provider) AS j FROM o) WHERE position > 5 AND position <= 12
""")
def result_window(spark, d):
    """A window of a result list around a selected row, as JSON texts."""
    from threadloom.plans.admin import page, result_window as window  # noqa: PLC0415

    found = searching.recent(corpus(spark, d), 30, _HERE)
    made = searching.to_json(page(found, *window(30, 8, 7)))
    return made.select(F.get_json_object("json", "$.position").cast("long").alias("position"), *(F.get_json_object("json", f"$.{c}").alias(c) for c in ("uid", "provider")))
