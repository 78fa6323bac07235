"""Tokens for the lexical index: plain words as a column expression, or folded and stemmed words as an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.porter import stem

_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def folded(text: str) -> list[str]:
    """Words without case and diacritics, stemmed."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return [stem(t) for t in _TOKEN.findall(plain.lower())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(text: pd.Series) -> pd.Series:
    return text.fillna("").map(folded)
