"""Text functions as column expressions."""

from __future__ import annotations

import re
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "[\\u4e00-\\u9fff]"
_RUN = "[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"


def clean_text(c: Column) -> Column:
    """White space runs become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def tokens(c: Column) -> Column:
    """Lexical tokens: single ideographs and Latin runs, then bigrams of the ideographs in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({CJK}|{_RUN})"), F.lit(1))
    signs = F.filter(found, lambda x: x.rlike(f"^{CJK}$"))
    n = F.greatest(F.size(signs) - 1, F.lit(0))
    return F.concat(found, F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), lambda a, b: F.concat(a, b)))


_FOUND = re.compile("[一-鿿]|[a-z0-9]+(?:[._/-][a-z0-9]+)*")


def tokens_of(text: str | None) -> list[str]:
    """``tokens`` of one text, for code that works on batches."""
    found = _FOUND.findall((text or "").lower())
    signs = [x for x in found if "\u4e00" <= x <= "\u9fff"]
    return found + [a + b for a, b in pairwise(signs)]


def token_count(c: Column) -> Column:
    """Ideographs, Latin runs and any other visible character."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?U)({CJK}|{_RUN}|\\S)"), F.lit(1)))


def char_ngrams(text: Column, n: int) -> Column:
    """Runs of n neighbouring characters; the characters are split once, not once per run."""
    signs = F.filter(F.split(text, ""), lambda x: x != "")
    m = F.greatest(F.size(signs) - (n - 1), F.lit(0))
    out = F.slice(signs, F.lit(1), m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(signs, F.lit(k + 1), m), lambda a, b: F.concat(a, b))
    return out


def char_bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring letters, digits and ideographs, lower-cased."""
    return F.array_distinct(char_ngrams(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z\\u4e00-\\u9fff]", ""), 2))


_PLAIN = re.compile("[^0-9a-z一-鿿]")


def _pairs_of(text: str | None) -> set[str]:
    plain = _PLAIN.sub("", (text or "").lower())
    return {a + b for a, b in pairwise(plain)}


@F.pandas_udf(T.DoubleType())
def bigram_share(asked: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the first text's ``char_bigrams`` that the second has; null where it has none.

    Sets of whole texts' pairs are an array per row and step in SQL; over Arrow they are built once.
    """
    out = []
    for a, b in zip(asked, text, strict=True):
        own = _pairs_of(a)
        out.append(len(own & _pairs_of(b)) / len(own) if own else None)
    return pd.Series(out, dtype="float64")


def normalized(c: Column) -> Column:
    """Word characters only, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)[^\\w]+", ""))


def text_sha256(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]", ""))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
