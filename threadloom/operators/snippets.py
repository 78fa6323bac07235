"""Excerpts of results with the query's words marked."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.porter import stem
from threadloom.functions.textops import collapse_space, let
from threadloom.plans.query import search_tokens

LENGTH = 220
OPEN, CLOSE, MORE = "«", "»", "…"
EXCERPT_TOKENS = 18


def truncate(text: Column, most: int = LENGTH) -> Column:
    return let(text, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit(MORE))))


def highlight(text: Column, free_text: str) -> Column:
    """Marks each word of the query, the longest first; marks of shorter words may stand inside those of longer ones."""
    terms = sorted((t for t in search_tokens(free_text) if len(t) > 1), key=len, reverse=True)
    for t in terms:
        flags = "(?i)" if t.isascii() else "(?iu)"
        text = F.regexp_replace(text, flags + re.sub(r"([^\w\s])", r"\\\1", t), f"{OPEN}$0{CLOSE}")
    return text


def excerpt(text: Column, free_text: str, most: int = LENGTH) -> Column:
    """About ``most`` characters around the first word of the query, in the query's order, that the text holds."""
    if not free_text.strip():
        return truncate(collapse_space(text), most)
    terms = [t.lower() for t in search_tokens(free_text) if len(t) > 1]

    def around(flat: Column, anchor: Column) -> Column:
        start = F.greatest(F.lit(1), anchor - most // 3)
        cut = F.trim(F.substring(flat, start, F.lit(most)))
        more = F.when(start - 1 + most < F.length(flat), MORE).otherwise("")
        return F.concat(F.when(start > 1, MORE).otherwise(""), cut, more)

    def shown(flat: Column) -> Column:
        if not terms:
            return truncate(highlight(flat, free_text), most)
        anchor = let(F.lower(flat), lambda low: F.coalesce(*(F.nullif(F.instr(low, F.lit(t)), F.lit(0)) for t in terms)))
        # a text without any of the words has nothing to mark
        return let(anchor, lambda a: F.when(a.isNull(), truncate(flat, most)).otherwise(highlight(around(flat, a), free_text)))

    return let(collapse_space(text), shown)


def choose(columns: list[str], free_text: str) -> tuple[Column, Column]:
    """(snippet, snippet_source): a preview; else the full-text excerpt unless the vector rank is better by more than 10; else the chunk; else the body."""
    choices: list[tuple[Column, Column, str]] = []

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    if "preview_snippet" in columns:
        choices.append((given("preview_snippet"), truncate(collapse_space(F.col("preview_snippet"))), "body"))
    if "fts_snippet" in columns:
        near = F.lit(True)
        if "keyword_rank" in columns and "vector_rank" in columns:
            near = F.coalesce(F.col("keyword_rank") <= F.col("vector_rank") + 10, F.lit(True))
        choices.append((given("fts_snippet") & near, truncate(collapse_space(F.col("fts_snippet"))), "fts"))
    if "semantic_snippet" in columns:
        choices.append((given("semantic_snippet"), excerpt(F.col("semantic_snippet"), free_text), "vector"))
    if "body" in columns:
        choices.append((given("body"), excerpt(F.col("body"), free_text), "body"))
    snippet = source = None
    for test, text, kind in choices:
        snippet = F.when(test, text) if snippet is None else snippet.when(test, text)
        source = F.when(test, kind) if source is None else source.when(test, kind)
    if snippet is None:
        return F.lit(""), F.lit("body")
    return snippet.otherwise(""), source.otherwise("body")


_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}\p{Mn}]+")


def _token_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        plain = "".join(c for c in unicodedata.normalize("NFD", m[0]) if unicodedata.category(c) != "Mn").lower()
        if plain:
            out.append((stem(plain), m.start(), m.end()))
    return out


def match_excerpt(text: str, phrases: list[list[str]], size: int = EXCERPT_TOKENS) -> str:
    """At most ``size`` tokens of the text around most of the phrases, matches marked; the text's start without a match."""
    spans = _token_spans(text)
    if not spans:
        return text
    stems = [s for s, _, _ in spans]
    hits: list[tuple[int, int, int]] = []
    for number, phrase in enumerate(phrases):
        n = len(phrase)
        hits += [(i, i + n, number) for i in range(len(stems) - n + 1) if n and stems[i : i + n] == phrase]
    hits.sort()
    first = 0
    if len(spans) > size and hits:
        best = (-1, 0)
        for i, _, _ in hits:
            inside = [h for h in hits if i <= h[0] and h[1] <= i + size]
            gain = 1000 * len({h[2] for h in inside}) + len(inside)
            if gain > best[0]:
                last = max((h[1] for h in inside), default=i)
                best = (gain, max(0, min(i - (size - (last - i)) // 2, len(spans) - size)))
        first = best[1]
    end = min(len(spans), first + size)
    marked: list[list[int]] = []
    for a, b, _ in hits:
        if first <= a and b <= end:
            if marked and a < marked[-1][1]:
                marked[-1][1] = max(marked[-1][1], b)
            else:
                marked.append([a, b])
    start = 0 if first == 0 else spans[first][1]
    stop = len(text) if end == len(spans) else spans[end - 1][2]
    out, at = [], start
    for a, b in marked:
        out += [text[at : spans[a][1]], OPEN, text[spans[a][1] : spans[b - 1][2]], CLOSE]
        at = spans[b - 1][2]
    out.append(text[at:stop])
    return MORE * (first > 0) + "".join(out) + MORE * (end < len(spans))


def full_text_snippet(text: Column, phrases: list[list[str]]) -> Column:
    """``match_excerpt`` on a column. For the rows of a result page, not for a corpus."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: match_excerpt(t, phrases))

    return cut(text)
