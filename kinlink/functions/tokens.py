"""Tokenisers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.text import collapse_spaces


def words(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)(\\w+)"), 1)


def char_grams(text: Column, low: int = 3, high: int = 3) -> Column:
    """Character n-grams within space-padded words; a padded word shorter than n is one gram itself."""
    padded = F.transform(F.filter(F.split(collapse_spaces(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_length(n: int) -> Column:
        def grams(w: Column) -> Column:
            last = F.greatest(F.length(w) - n + 1, F.lit(1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))

        fitting = padded if n == low else F.filter(padded, lambda w: F.length(w) >= n)
        return F.flatten(F.transform(fitting, grams))

    return F.concat(*[of_length(n) for n in range(low, high + 1)])


def components(text: Column) -> Column:
    """Trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda c: F.btrim(c)), lambda c: c != "")


def numbers(text: Column) -> Column:
    """Number tokens: digits with at most one letter behind."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\b(\\d+[a-z]?)\\b"), 1)


def map_tokens(text: Column) -> Column:
    """Tokens that a learned word map is keyed by."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\s,.\\-()\\[\\]/&+]+)"), 1)


def hashed(tokens: Column, buckets: int = 1 << 22) -> Column:
    """Distinct hash buckets of tokens (binary feature hashing)."""
    return F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets))))
