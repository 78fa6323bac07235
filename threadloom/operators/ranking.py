"""Filters, rank fusion, score parts and orders of search results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.textops import trim
from threadloom.plans.query import Filters, TextPlan

RRF_K = 60


@dataclass(frozen=True)
class Weights:
    rrf_k: int = RRF_K
    recency: float = 0.08
    half_life_days: float = 30.0
    repo: float = 0.10
    cwd: float = 0.05
    title_substring: float = 0.12
    title_tokens: float = 0.08
    first_prompt_exactish: float = 0.10
    body_exactish: float = 0.08
    short: float = 0.06
    subagent: float = 0.20
    missing_cwd: float = 0.03
    #: Decimals of the recency part, and of the score that a search orders by; all of them where none are given.
    recency_digits: int | None = None
    score_digits: int | None = None


def moment(text: Column) -> Column:
    """The instant of an ISO text; null where it can't be read."""
    return F.try_to_timestamp(text)


def contains_all(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(p)) for p in parts), F.lit(True))


def filter_condition(f: Filters) -> Column:
    """What a session must meet; rows whose updated_at can't be read never pass."""
    at = moment(F.col("updated_at"))
    tests = [at.isNotNull()]
    if f.provider:
        tests.append(F.col("provider") == f.provider)
    if f.repo:
        tests.append((F.col("repo") == f.repo) | F.contains(F.lower("cwd"), F.lit(f.repo.lower())))
    if f.branch:
        tests.append(F.col("branch") == f.branch)
    if f.surface:
        tests.append(F.col("surface") == f.surface)
    if not f.include_subagents:
        tests.append(~F.col("is_subagent"))
    if f.since:
        tests.append(at >= moment(F.lit(f.since)))
    if f.until:
        tests.append(at <= moment(F.lit(f.until)))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (F.lit(k) + rank)


def rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query, uid, fusion_score) of any number of ranked lists (query, uid, rank)."""
    return lists.groupBy("query", "uid").agg(F.sum(rrf(F.col("rank"), k)).alias("fusion_score"))


def fuse(keyword: DataFrame, vector: DataFrame, key: tuple[str, ...] = ("query", "uid"), k: int = RRF_K) -> DataFrame:
    """Keyword and vector hits as one table. The keyword row's values win where both have one that isn't empty."""
    a, b = keyword.alias("a"), vector.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in key))
    names = list(dict.fromkeys([*keyword.columns, *vector.columns]))

    def pick(name: str) -> Column:
        if name not in vector.columns:
            return F.col(f"a.{name}")
        if name not in keyword.columns:
            return F.col(f"b.{name}")
        left = F.col(f"a.{name}")
        blank = dict(keyword.dtypes)[name] == "string" and name not in key
        return F.coalesce(F.nullif(left, F.lit("")) if blank else left, F.col(f"b.{name}"), left)

    score = F.coalesce(rrf(F.col("a.keyword_rank"), k), F.lit(0.0)) + F.coalesce(rrf(F.col("b.vector_rank"), k), F.lit(0.0))
    return a.join(b, on, "full_outer").select(*(pick(n).alias(n) for n in names), score.alias("fusion_score"))


def base_score(columns: list[str], k: int = RRF_K) -> Column:
    """The fused score where there is one, else the parts of the ranks, else of the raw scores."""

    def part(rank: str, score: str) -> Column:
        found = [rrf(F.col(rank), k)] if rank in columns else []
        found += [F.col(score)] if score in columns else []
        return F.coalesce(*found, F.lit(0.0))

    parts = part("keyword_rank", "keyword_score") + part("vector_rank", "vector_score")
    return F.coalesce(F.col("fusion_score"), parts) if "fusion_score" in columns else parts


def recency(now: datetime, w: Weights) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.lit(now.timestamp()) - moment(F.col("updated_at")).cast("double")) / 86_400)
    return F.coalesce(rounded(F.lit(w.recency) * F.pow(F.lit(0.5), age_days / w.half_life_days), w.recency_digits), F.lit(0.0))


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def cwd_matches(current: str | None) -> Column:
    """Either path begins with the other, as text."""
    if not current:
        return F.lit(False)
    own, there = F.replace(F.col("cwd"), F.lit("\\"), F.lit("/")), F.lit(current.replace("\\", "/"))
    return F.coalesce((own != "") & (F.startswith(own, there) | F.startswith(there, own)), F.lit(False))


def is_short() -> Column:
    return (F.col("message_count") < 4) | (F.length(trim(F.coalesce(F.col("body"), F.lit("")))) < 240)


def _when(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def score_parts(
    columns: list[str],
    plan: TextPlan,
    now: datetime,
    filters: Filters = Filters(),
    current_repo: str | None = None,
    current_cwd: str | None = None,
    w: Weights = Weights(),
) -> dict[str, Column]:
    """The parts of a search score, by name, and their total."""
    title = F.lower("title")
    prompt, body = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("first_prompt", "body"))
    exactish = sum(
        (
            F.when(F.contains(prompt, F.lit(t.lower())), w.first_prompt_exactish).when(F.contains(body, F.lit(t.lower())), w.body_exactish).otherwise(0.0)
            for t in plan.exactish
        ),
        F.lit(0.0),
    )
    parts = {
        "base_score": base_score(columns, w.rrf_k),
        "title_boost": (
            _when(F.contains(title, F.lit(plan.normalized.lower())), w.title_substring) if plan.normalized else F.lit(0.0)
        )
        + (_when(contains_all(title, [t.lower() for t in plan.tokens]), w.title_tokens) if plan.tokens else F.lit(0.0)),
        "exactish_boost": exactish,
        **_shared_parts(now, filters, current_repo, current_cwd, w),
    }
    return {**parts, "total": _total(parts)}


def _shared_parts(now: datetime, filters: Filters, current_repo: str | None, current_cwd: str | None, w: Weights) -> dict[str, Column]:
    in_repo = F.coalesce(F.col("repo") == current_repo, F.lit(False)) if current_repo and not filters.repo else F.lit(False)
    return {
        "recency_boost": recency(now, w),
        "repo_boost": _when(in_repo, w.repo),
        "cwd_boost": _when(cwd_matches(current_cwd), w.cwd),
        "short_penalty": _when(is_short(), w.short),
        "subagent_penalty": _when(F.col("is_subagent"), w.subagent),
        "missing_cwd_penalty": _when(trim(F.coalesce(F.col("cwd"), F.lit(""))) == "", w.missing_cwd),
    }


def _total(parts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, (-v if k.endswith("penalty") else v for k, v in parts.items()))


def browse_parts(
    now: datetime, filters: Filters = Filters(), current_repo: str | None = None, current_cwd: str | None = None, w: Weights = Weights()
) -> dict[str, Column]:
    """The parts of a score without a query, and their total."""
    parts = _shared_parts(now, filters, current_repo, current_cwd, w)
    return {**parts, "total": _total(parts)}


def search_order(plan: TextPlan, score: str = "score") -> list[Column]:
    """Best score, then a title that holds the query, then the latest, then the better keyword rank, then uid."""
    hit = F.contains(F.lower("title"), F.lit(plan.normalized.lower())) if plan.normalized else F.lit(False)
    return [F.desc(score), hit.desc(), moment(F.col("updated_at")).desc_nulls_last(), F.asc_nulls_last("keyword_rank"), F.asc("uid")]


def browse_order(score: str = "score") -> list[Column]:
    return [F.desc(score), moment(F.col("updated_at")).desc_nulls_last(), F.asc("uid")]
