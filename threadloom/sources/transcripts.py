"""Transcript files of three providers as rows.

Files are listed with their metadata first; contents are read for the files that are asked for. A file's lines are
numbered, parsed to variants, and cut off where too many are invalid; each provider's records then map to one event
schema, and the same aggregation makes a session row of each file.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.textops import clean_text, is_noise, trim
from threadloom.operators.sessions import last_known
from threadloom.schemas import PROVIDERS, TURN

# What discovery passes over, and the limits of invalid lines.
SKIPPED_NAMES, SKIPPED_ENDS, SKIPPED_DIRS = (".DS_Store",), (".lock", ".tmp", ".temp", ".swp", ".swo", "~"), (".git", "node_modules")
MOST_INVALID_LINES, MOST_INVALID_RATE = 25, 0.35
UUID = r"(?i)([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
ISO = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"

FILES = "provider string, path string, relative string, size long, mtime_ms double, likely_subagent boolean"


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/+", "/")


def kept_entry(relative: Column) -> Column:
    """No part of the path below the root is a skipped directory or a temporary file."""
    parts = F.split(relative, "/")
    return ~F.exists(
        parts,
        lambda p: p.isin(*SKIPPED_NAMES, *SKIPPED_DIRS) | _any(p.endswith(e) for e in SKIPPED_ENDS),
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def provider_file(provider: str, relative: Column) -> Column:
    """Whether a file below a root is a transcript of the provider."""
    name = F.substring_index(relative, "/", -1)
    jsonl = name.endswith(".jsonl")
    if provider == "claude":
        return jsonl & (F.size(F.split(relative, "/")) == 2)
    if provider == "codex":
        return jsonl & name.startswith("rollout-")
    return jsonl & (name != "run-history.jsonl")


def subagent_path(provider: Column, path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    board = low.contains("agent-board/worktrees/view_") | low.contains("agent-view")
    codex = low.contains('thread_source":"subagent') | low.contains("/subagent/") | (low.contains("codex desktop") & low.contains("subagent"))
    pi = board | low.contains(".pi-agent-agent-board-worktrees-view_") | low.contains("hackerclaw")
    return F.when(provider == "codex", codex).when(provider == "pi", pi).otherwise(board)


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discover(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """FILES of every provider's roots; a root that isn't there has none. Contents aren't read."""
    found = spark.createDataFrame([], FILES)
    for provider in PROVIDERS:
        for root in roots.get(provider, []):
            if not _exists(spark, root):
                continue
            base = root.rstrip("/").removeprefix("file:")
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
            files = files.coalesce(max(1, spark.sparkContext.defaultParallelism))  # what is known of them came with the list
            path = plain_path(F.col("path"))
            relative = F.substring(path, F.lit(len(base) + 2), F.length(path))
            files = files.select(
                F.lit(provider).alias("provider"),
                path.alias("path"),
                relative.alias("relative"),
                F.col("length").alias("size"),
                (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"),
                subagent_path(F.lit(provider), path).alias("likely_subagent"),
            )
            found = found.unionByName(files.filter(kept_entry(F.col("relative")) & provider_file(provider, F.col("relative"))))
    return found.dropDuplicates(["provider", "path"])


#: Up to so many files are named to the reader; more are read from their roots and joined.
NAMED_FILES = 10_000
#: Files and their bytes that a task reads. The reader by itself gives a small file the part of a task that 4 MB would take.
TASK_FILES, TASK_BYTES = 256, 1 << 26


def contents(spark: SparkSession, roots: dict[str, list[str]], files: DataFrame) -> DataFrame:
    """``files`` with their ``content`` as text and its ``sha256``. Only these files are opened, as long as they are few: what a sync
    reads then follows from what has changed, not from what there is."""
    paths = sorted({r["path"] for r in files.select("path").distinct().limit(NAMED_FILES + 1).collect()})
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl")
    if len(paths) <= NAMED_FILES:
        read = source.load([_glob_safe(p) for p in paths]) if paths else spark.createDataFrame([], "path string, content binary")
    else:
        found = [r for r in _outermost(r for rs in roots.values() for r in rs) if _exists(spark, r)]
        read = source.option("recursiveFileLookup", True).load(found)
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    read = read.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-(size or 0) // TASK_BYTES)))
    read = read.select(plain_path(F.col("path")).alias("path"), "content")
    text = F.decode("content", "utf-8")
    return files.join(read, "path").withColumns({"sha256": F.sha2("content", 256), "content": text})


def _glob_safe(path: str) -> str:
    """A path that a reader takes as it is, not as a pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _outermost(roots) -> list[str]:
    """Roots that lie below no other one, so that no file is read twice."""
    out: list[str] = []
    for root in sorted({r.rstrip("/") for r in roots}):
        if not any(root.startswith(o + "/") for o in out):
            out.append(root)
    return out


def json_lines(files: DataFrame, most: int = MOST_INVALID_LINES, rate: float = MOST_INVALID_RATE) -> DataFrame:
    """(provider, path, line_no, raw, value, is_bad) of ``files(provider, path, content)``, up to where reading stops.

    Blank lines count but give no row. Reading stops at an invalid first line, at the ``most``-th invalid line, or
    at an invalid line by which more than ``rate`` of all lines were invalid; that line is the last.
    """
    lines = files.select("provider", "path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("n", "raw")).select(
        "provider", "path", (F.col("n") + 1).alias("line_no"), "raw"
    )
    lines = lines.filter(trim(F.col("raw")) != "").withColumn("value", F.try_parse_json("raw"))
    return cut_invalid(lines.withColumn("is_bad", F.col("value").isNull()), most, rate)


def cut_invalid(lines: DataFrame, most: int = MOST_INVALID_LINES, rate: float = MOST_INVALID_RATE, key: str = "path") -> DataFrame:
    """Rows (key, line_no, is_bad, ...) up to the line at which reading stops."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.sum(F.col("is_bad").cast("long")).over(so_far)
    stop = F.col("is_bad") & ((F.col("line_no") == 1) | (bad >= most) | (bad / F.col("line_no") > rate))
    marked = lines.withColumn("__stop", stop)
    stops = F.min(F.when(F.col("__stop"), F.col("line_no"))).over(Window.partitionBy(key))
    return marked.withColumn("__at", stops).filter("__at is null or line_no <= __at").drop("__stop", "__at")


# -- fields of variants ---------------------------------------------------------------------------------------------


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def raw_text(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def text_field(value: Column, path: str) -> Column:
    """A string without outer white space; null where it is missing, empty or of another type."""
    return F.nullif(trim(raw_text(value, path)), F.lit(""))


def is_object(value: Column, path: str) -> Column:
    return F.coalesce(F.startswith(_kind(value, path), F.lit("OBJECT")), F.lit(False))


def iso_timestamp(value: Column, path: str) -> Column:
    """An ISO-looking string as it is, or a number of milliseconds as one."""
    text, kind = raw_text(value, path), _kind(value, path)
    millis = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, path, "double").cast("long"))
    return F.coalesce(F.when(text.rlike(ISO), text), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def content_text(value: Column, path: str, kinds: tuple[str, ...]) -> Column:
    """A string as it is; the texts of a list's parts of these kinds, a blank line between; else empty."""
    parts = F.filter(F.try_variant_get(value, path, "array<variant>"), lambda p: text_field(p, "$.type").isin(*kinds))
    texts = F.filter(F.transform(parts, lambda p: text_field(p, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(raw_text(value, path), F.array_join(texts, "\n\n"), F.lit(""))


def infer_surface(text: Column) -> Column:
    """Null for a null text."""
    low = F.lower(text)
    return F.when(low.isNull(), None).otherwise(
        F.when(low.contains("vscode") | low.contains("ide"), "ide")
        .when(low.contains("desktop"), "desktop")
        .when(low.contains("subagent"), "subagent")
        .when(low.contains("cloud"), "cloud")
        .otherwise("cli")
    )


# -- records -> events ------------------------------------------------------------------------------------------------

EVENT_FIELDS = ("ts", "meta_ts", "native_id", "cwd", "branch", "surface", "title", "last_prompt", "model", "subagent", "role", "text", "turn_model")


def _events(lines: DataFrame, **fields: Column) -> DataFrame:
    given = {"ts": raw_text(F.col("value"), "$.timestamp"), **fields}
    kinds = {"subagent": "boolean"}
    return lines.select(
        "provider", "path", "line_no", "raw", "value", "is_bad", *(given.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in EVENT_FIELDS)
    )


def claude_events(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    kind, role = text_field(v, "$.type"), text_field(v, "$.message.role")
    turn = kind.isin("user", "assistant") & role.isin("user", "assistant")
    surface = infer_surface(raw_text(v, "$.entrypoint"))
    return _events(
        lines,
        native_id=text_field(v, "$.sessionId"),
        cwd=text_field(v, "$.cwd"),
        branch=text_field(v, "$.gitBranch"),
        surface=F.when(surface != "cli", surface),
        title=F.when(kind == "ai-title", text_field(v, "$.aiTitle")),
        last_prompt=F.when(kind == "last-prompt", F.nullif(clean_text(text_field(v, "$.lastPrompt"), F.lit("claude")), F.lit(""))),
        model=F.when(turn, text_field(v, "$.message.model")),
        role=F.when(turn, role),
        text=F.when(turn, content_text(v, "$.message.content", ("text",))),
        turn_model=F.when(turn, text_field(v, "$.message.model")),
    )


def codex_events(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    kind = F.when(is_object(v, "$.payload"), text_field(v, "$.type"))
    meta, role = kind == "session_meta", text_field(v, "$.payload.role")
    turn = (kind == "response_item") & (text_field(v, "$.payload.type") == "message") & role.isin("user", "assistant")
    by_source = F.coalesce(F.startswith(_kind(v, "$.payload.source.subagent"), F.lit("")), F.lit(False))
    source = infer_surface(raw_text(v, "$.payload.source"))
    renamed = (kind == "event_msg") & (text_field(v, "$.payload.type") == "thread_name_updated")
    return _events(
        lines,
        meta_ts=F.when(meta, text_field(v, "$.payload.timestamp")),
        native_id=F.when(meta, text_field(v, "$.payload.id")),
        cwd=F.when(meta, text_field(v, "$.payload.cwd")),
        surface=F.when(meta, F.when(source == "ide", "ide").otherwise("cli")),
        title=F.when(meta | renamed, text_field(v, "$.payload.thread_name")),
        model=F.when(kind == "turn_context", text_field(v, "$.payload.model")),
        subagent=F.when(meta, F.coalesce(text_field(v, "$.payload.thread_source") == "subagent", F.lit(False)) | by_source),
        role=F.when(turn, role),
        text=F.when(turn, content_text(v, "$.payload.content", ("input_text", "output_text", "text"))),
    )


def pi_events(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    kind, role = text_field(v, "$.type"), text_field(v, "$.message.role")
    session, turn = kind == "session", (kind == "message") & role.isin("user", "assistant")
    change = F.when(kind == "model_change", F.struct(text_field(v, "$.modelId").alias("id")))
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    active = F.last(change, ignorenulls=True).over(so_far)["id"]  # a change without an id resets it
    return _events(
        lines,
        meta_ts=F.when(session, text_field(v, "$.timestamp")),
        native_id=F.when(session, text_field(v, "$.id")),
        cwd=F.when(session, text_field(v, "$.cwd")),
        model=change["id"],
        role=F.when(turn, role),
        text=F.when(turn, content_text(v, "$.message.content", ("text",))),
        turn_model=F.when(turn, active),
    )


EVENTS = {"claude": claude_events, "codex": codex_events, "pi": pi_events}


def decode_project_dir(name: Column) -> Column:
    """A dash-encoded project directory as a path, each dash a separator; ``--x`` stands for ``/.x``."""
    inner = F.regexp_replace(name, r"\A-", "")
    return F.when(inner != "", F.concat(F.lit("/"), F.replace(F.replace(inner, F.lit("--"), F.lit("/.")), F.lit("-"), F.lit("/"))))


def decode_with(name: str, exists: Callable[[str], bool]) -> str | None:
    """A dash-encoded project directory as a path whose parts are known to exist where that can be: dashes may belong to names.

    At each step the longest name that exists is taken; without one, the next part alone.
    """
    parts = name.removeprefix("-").split("-")
    path, at = "", 0
    while at < len(parts):
        for n in range(len(parts) - at, 0, -1):
            some = parts[at : at + n]
            step = "." + "-".join(some[1:]) if some[0] == "" else "-".join(some)
            if step and (n == 1 or step != "." and exists(f"{path}/{step}")):
                break
        path, at = path if step == "." else f"{path}/{step}", at + n  # an empty part alone adds nothing
    return path or None


def decoder(exists: Callable[[str], bool]) -> Callable[[Column], Column]:
    """``decode_with`` for columns; ``exists`` runs in tasks and must see there what it is to see."""

    @F.pandas_udf(T.StringType())
    def decode(names: pd.Series) -> pd.Series:
        return names.map(lambda n: decode_with(n, exists) if n else None)

    return decode


def parse_files(files: DataFrame, decode: Callable[[Column], Column] = decode_project_dir) -> tuple[DataFrame, DataFrame]:
    """(PARSED rows, failures(provider, path, error)) of ``files(provider, path, size, content)``.

    A file fails where a line before the stop is the JSON value null.
    """
    return split_failures(parse_all(files, decode))


def split_failures(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``parse_files`` returns, of the rows of ``parse_all``."""
    return known.filter(~F.col("failed")).drop("failed"), known.filter("failed").select("provider", "path", F.lit("a record is null").alias("error"))


def parse_all(files: DataFrame, decode: Callable[[Column], Column] = decode_project_dir) -> DataFrame:
    """PARSED rows of all files, also of those that have ``failed``. Contents are read three times, so these should lie staged."""
    lines = json_lines(files)
    events = None
    for provider, make in EVENTS.items():
        one = make(lines.filter(F.col("provider") == provider))
        events = one if events is None else events.unionByName(one)
    turn_text = clean_text(F.col("text"), F.col("provider"))
    events = events.withColumn("text", turn_text).withColumn("is_null", F.coalesce(_kind(F.col("value"), "$") == "VOID", F.lit(False)))
    is_turn = F.col("role").isNotNull() & ~is_noise(F.col("text"))
    turn = F.struct("line_no", F.struct("role", "text", F.col("ts").alias("timestamp"), F.col("turn_model").alias("model")).alias("turn"))
    user = F.when(is_turn & (F.col("role") == "user"), F.struct("line_no", "text"))
    warning = F.when(F.col("is_bad"), F.struct("line_no", F.concat(F.lit("line "), F.col("line_no"), F.lit(": invalid JSON")).alias("w")))
    found = events.groupBy("provider", "path").agg(
        *(last_known(c, "line_no").alias(c) for c in ("native_id", "cwd", "branch", "surface", "title", "last_prompt")),
        F.least(F.min("ts"), F.min("meta_ts")).alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.array_sort(F.collect_set("model")).alias("models"),
        F.coalesce(F.bool_or("subagent"), F.lit(False)).alias("said_subagent"),
        F.min(user)["text"].alias("first_user"),
        F.transform(F.array_sort(F.collect_list(F.when(is_turn, turn))), lambda t: t["turn"]).cast(f"array<{TURN}>").alias("turns"),
        F.transform(F.array_sort(F.collect_list(warning)), lambda w: w["w"]).alias("warnings"),
        F.bool_or("is_null").alias("failed"),
    )
    known = files.select("provider", "path", F.col("size").alias("raw_bytes")).join(found, ["provider", "path"], "left")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl\z", "")
    provider = F.col("provider")
    parent = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    cwd = F.when(provider == "claude", F.coalesce("cwd", decode(parent))).otherwise(F.col("cwd"))
    known = known.withColumns(
        {
            "native_id": F.coalesce("native_id", F.nullif(F.regexp_extract("path", UUID, 1), F.lit("")), stem),
            "cwd": cwd,
            "models": F.coalesce("models", F.expr("cast(array() as array<string>)")),
            "warnings": F.coalesce("warnings", F.expr("cast(array() as array<string>)")),
            "turns": F.coalesce("turns", F.expr(f"cast(array() as array<{TURN}>)")),
        }
    )
    by_path = subagent_path(provider, F.col("path")) | subagent_path(provider, F.col("cwd"))
    known = known.withColumn("is_subagent", F.when(provider == "codex", F.coalesce("said_subagent", F.lit(False))).otherwise(by_path))
    return known.select(
        "provider",
        "native_id",
        "path",
        "cwd",
        "branch",
        F.when(F.col("is_subagent"), "subagent").otherwise(F.coalesce("surface", F.lit("cli"))).alias("surface"),
        "title",
        F.coalesce("first_user", "last_prompt").alias("first_prompt"),
        "created_at",
        "updated_at",
        "models",
        "is_subagent",
        "turns",
        "raw_bytes",
        "warnings",
        F.coalesce(F.col("failed"), F.lit(False)).alias("failed"),
    )
