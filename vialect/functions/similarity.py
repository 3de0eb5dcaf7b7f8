"""Similarity of names: n-gram Jaccard and the InDel ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of each word; a shorter word is one itself."""

    def of(word: Column) -> Column:
        return F.when(F.length(word) < n, F.array(word)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))
        )

    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), of)))


def jaccard(a: Column, b: Column) -> Column:
    """Common by all members; 0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (len a + len b), 1 for two empty strings."""
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def letters(text: Column) -> Column:
    """The characters of a text as distinct members: each with the number of its earlier occurrences."""
    chars = F.split(text, "")
    sorted_ = F.array_sort(F.filter(chars, lambda c: c != ""))
    return F.transform(sorted_, lambda c, i: F.concat(c, F.lit("#"), (i - F.array_position(sorted_, c) + 1).cast("string")))
