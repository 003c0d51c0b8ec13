"""Text to tokens: Column to Column and DataFrame to DataFrame, all on the JVM unless exact folding is asked for."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APOSTROPHES = "’ʼ"
LOWER_TOKEN, CASED_TOKEN = "[a-z]+(?:'[a-z]+)*", "[A-Za-z]+(?:'[A-Za-z]+)*"
#: Endings that are split off as tokens of their own.
CLITICS = ("s", "t", "ll", "re", "ve", "d", "m")
_CLITIC = "^(.*?)('(?:" + "|".join(CLITICS) + "))$"
_START = r"(?is)^.*?\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
_END = r"(?is)\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG EBOOK.*?\*\*\*.*$"


def strip_boilerplate(text: Column) -> Column:
    """Drop all up to the first start mark, then all from the first end mark after it; unmarked text passes."""
    return F.regexp_replace(F.regexp_replace(text, _START, ""), _END, "")


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility decomposition, without marks, is one ASCII letter."""
    source, target = [], []
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


def fold_accents(text: Column, exact: bool = False) -> Column:
    """Letters without their marks.

    The default translates single letters and drops combining marks: for tokens the same as the
    decomposition, save for signs that decompose to several letters (such as ligatures). ``exact``
    decomposes in an Arrow UDF.
    """
    if exact:

        @F.pandas_udf("string")
        def fold(s: pd.Series) -> pd.Series:
            return s.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

        return fold(text)
    return F.regexp_replace(F.translate(text, *fold_table()), r"\p{Mn}", "")


def normalise(text: Column, lowercase: bool = True, fold: bool = True, exact: bool = False) -> Column:
    """Apostrophes to one kind, then folding, then lower case, in this order.

    A text of as many bytes as characters is ASCII, which neither step changes, so it skips both.
    """
    out = F.translate(text, APOSTROPHES, "''")
    if fold:
        out = fold_accents(out, exact)
    if not exact:
        out = F.when(F.octet_length(text) == F.length(text), text).otherwise(out)
    return F.lower(out) if lowercase else out


def token_array(text: Column, lowercase: bool = True, fold: bool = True, split_clitics: bool = False, exact: bool = False) -> Column:
    """All tokens of a text, left to right; null texts have none."""
    found = F.regexp_extract_all(normalise(text, lowercase, fold, exact), F.lit(LOWER_TOKEN if lowercase else CASED_TOKEN), F.lit(0))
    if split_clitics:
        stem = lambda t: F.regexp_extract(t, _CLITIC, 1)
        found = F.flatten(F.transform(found, lambda t: F.when(t.contains("'") & (stem(t) != ""), F.array(stem(t), F.regexp_extract(t, _CLITIC, 2))).otherwise(F.array(t))))
    return F.coalesce(found, F.array().cast("array<string>"))


def tokens(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_ord, pos, token): a document's tokens with their order as data."""
    return docs.select(F.col(doc_col).alias("doc_ord"), F.posexplode(token_array(F.col(text_col), **options)).alias("pos", "token"))


def token_lists(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_ord, t): a document's tokens as one array."""
    return docs.select(F.col(doc_col).alias("doc_ord"), token_array(F.col(text_col), **options).alias("t"))
