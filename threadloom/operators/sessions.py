"""From parsed transcript files to merged sessions and their documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.textops import clean_text, fork_command, is_noise, resume_command, synthesize_title
from threadloom.schemas import CHUNK_VERSION, NORMALIZE_VERSION, UNKNOWN_CWD


def first_known(value: str, order: str = "path") -> Column:
    """The value of the first row, by ``order``, that has one."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]


def last_known(value: str, order: str) -> Column:
    return F.max(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]


def merge_files(parsed: DataFrame) -> DataFrame:
    """One row per (provider, native_id), without turns: what the files of a session say together."""
    return parsed.groupBy("provider", "native_id").agg(
        *(first_known(c).alias(c) for c in ("cwd", "branch", "title", "first_prompt")),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.when(F.bool_or(F.col("surface") == "subagent"), "subagent")
        .otherwise(F.coalesce(F.min(F.when(F.col("surface") != "cli", F.struct("path", "surface")))["surface"], F.lit("cli")))
        .alias("surface"),
        F.bool_or("is_subagent").alias("is_subagent"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
        F.array_sort(F.collect_set("path")).alias("transcript_paths"),
        F.sum("raw_bytes").alias("bytes"),
        F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("warnings"),
    )


def ordered_turns(parsed: DataFrame) -> DataFrame:
    """(provider, native_id, at, path, pos, role, text, timestamp, model): the turns of a session's files in one order.

    Turns go by time, then file, then place in the file; one without a time keeps that of the turn before it.
    """
    turns = parsed.select("provider", "native_id", "path", F.posexplode("turns").alias("pos", "turn")).select(
        "provider", "native_id", "path", "pos", "turn.*"
    )
    before = Window.partitionBy("provider", "native_id").orderBy("path", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("at", F.last("timestamp", ignorenulls=True).over(before))


def kept_turns(turns: DataFrame, keys: tuple[str, ...] = ("provider", "native_id"), order: tuple[str, ...] = ("at", "path", "pos")) -> DataFrame:
    """Cleaned turns without empty and machine-written ones and without one that repeats the turn before it."""
    cleaned = turns.withColumn("text", clean_text(F.col("text"), F.col("provider"))).filter(~is_noise(F.col("text")))
    return drop_repeats(cleaned, keys, order)


def drop_repeats(turns: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*(F.asc_nulls_first(c) for c in order))
    this = F.struct("role", "text")
    return turns.withColumn("__same", F.coalesce(F.lag(this).over(by) == this, F.lit(False))).filter("not __same").drop("__same")


def body_of(turns: Column) -> Column:
    """``turns``: ordered structs with role and text."""
    said = F.transform(turns, lambda t: F.concat(F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), t["text"]))
    return F.array_join(said, "\n\n")


def base_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([^/]+)/*\z", 1), F.lit(""))


def default_repo(cwd: Column) -> Column:
    """The last part of the path. A resolver that looks at file systems can take its place."""
    return F.when((cwd != UNKNOWN_CWD) & (cwd != ""), base_name(cwd))


def enclosing_repo(exists: Callable[[str], bool]) -> Callable[[Column], Column]:
    """The name of the nearest folder around a path that holds ``.git``, else the last part of the path.

    ``exists`` runs in tasks and must see there what it is to see; each distinct path of a batch is looked up once.
    """

    def name(path: str | None) -> str | None:
        if not path or path == UNKNOWN_CWD:
            return None
        parts = [p for p in path.split("/") if p]
        for n in range(len(parts), 0, -1):
            if exists("/" + "/".join(parts[:n]) + "/.git"):
                return parts[n - 1]
        return parts[-1] if parts else None

    @F.pandas_udf(T.StringType())
    def names(paths: pd.Series) -> pd.Series:
        known = {p: name(p) for p in paths.unique()}
        return paths.map(lambda p: known[p])

    return names


def normalize(
    parsed: DataFrame,
    indexed_at: str,
    prefer_pi_session_id: bool = False,
    repo: Callable[[Column], Column] = default_repo,
    normalize_version: str = NORMALIZE_VERSION,
    chunk_version: str = CHUNK_VERSION,
) -> DataFrame:
    """Session documents: the columns of ``sessions`` and ``body``, one row per session."""
    key = ["provider", "native_id"]
    turns = kept_turns(ordered_turns(parsed))
    fields = F.struct("at", "path", "pos", "role", "text", "timestamp", "model")
    gathered = turns.groupBy(*key).agg(F.array_sort(F.collect_list(fields)).alias("turns"))
    s = merge_files(parsed).join(gathered, key, "left")
    s = s.withColumn("turns", F.coalesce("turns", F.expr("cast(array() as array<struct<at:string,path:string,pos:int,role:string,text:string,timestamp:string,model:string>>)")))
    provider = F.col("provider")
    s = s.withColumns(
        {
            "first_user": F.try_element_at(F.filter("turns", lambda t: t["role"] == "user"), F.lit(1))["text"],
            "native_title": clean_text(F.coalesce("title", F.lit("")), provider),
            "clean_prompt": clean_text(F.coalesce("first_prompt", F.lit("")), provider),
            "cwd": F.coalesce("cwd", F.lit(UNKNOWN_CWD)),
        }
    )
    s = s.withColumns(
        {
            "title": F.coalesce(F.nullif("native_title", F.lit("")), synthesize_title(F.col("first_user"))),
            "title_source": F.when(F.col("native_title") != "", "native").otherwise("synthesized"),
        }
    )
    created = F.coalesce("created_at", F.try_element_at("turns", F.lit(1))["timestamp"], F.lit(indexed_at))
    s = s.withColumns(
        {
            "uid": F.concat_ws(":", *key),
            "first_prompt": F.coalesce(F.nullif("clean_prompt", F.lit("")), F.nullif("first_user", F.lit("")), "title"),
            "body": body_of(F.col("turns")),
            "repo": repo(F.col("cwd")),
            "created_at": created,
            "updated_at": F.coalesce("updated_at", F.try_element_at("turns", F.lit(-1))["timestamp"], created),
            "surface": F.when(F.col("is_subagent"), "subagent").otherwise(F.col("surface")),
            "message_count": F.size("turns").cast("long"),
            "models": F.array_distinct(F.concat("models", F.filter(F.transform("turns", lambda t: t["model"]), lambda m: F.coalesce(m, F.lit("")) != ""))),
            "resume_cmd": resume_command(provider, F.col("native_id"), F.col("cwd"), prefer_pi_session_id),
            "fork_cmd": fork_command(provider, F.col("native_id"), F.col("cwd")),
            "normalize_version": F.lit(normalize_version),
            "chunk_version": F.lit(chunk_version),
            "indexed_at": F.lit(indexed_at),
        }
    )
    return s.withColumn("body_sha256", body_hash("title", "first_prompt", "body", "updated_at", "normalize_version")).drop(
        "turns", "first_user", "native_title", "clean_prompt", "warnings"
    )


def body_hash(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)
