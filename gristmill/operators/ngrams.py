"""Repeated n-grams of words inside a text, counted row by row in Arrow batches: nothing is shuffled."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

SIZES = range(2, 11)
#: The most of a text that the most frequent n-gram (2 to 4) and all repeated n-grams (5 to 10) may make up.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def _repeated(parts: list[str]) -> float:
    """Share of the stripped, not blank parts that repeat an earlier one."""
    solid = [x for x in map(str.strip, parts) if x]
    return 1 - len(set(solid)) / len(solid) if solid else 0.0


def fractions(text: str | None) -> list[float]:
    """For n of SIZES: top fraction ``max count * n / words``, then duplicate fraction ``sum of counts over one * n / words``; then the shares of repeated lines and paragraphs."""
    text = text or ""
    ws = text.lower().split()
    total = len(ws)
    top, dup = [0.0] * len(SIZES), [0.0] * len(SIZES)
    if total >= 2:
        ids: dict[str, int] = {}
        one = np.array([ids.setdefault(w, len(ids)) for w in ws], dtype=np.int64)
        gram, width = one, len(ids)
        for k, n in enumerate(SIZES):
            if total < n:
                break
            key = gram[: total - n + 1] * width + one[n - 1 :]
            order = key.argsort()
            key = key[order]
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            rank = new.cumsum() - 1
            counts = np.bincount(rank)
            most = int(counts.max())
            top[k] = most * n / total
            if most == 1:  # no longer n-gram is repeated either
                for j, m in enumerate(list(SIZES)[k + 1 :], k + 1):
                    if total >= m:
                        top[j] = m / total
                break
            dup[k] = int(counts[counts > 1].sum()) * n / total
            gram = np.empty(len(key), np.int64)
            gram[order] = rank
    return top + dup + [_repeated(text.splitlines()), _repeated(text.split("\n\n"))]


def with_fractions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array column ``_grams``: 9 top fractions and 9 duplicate fractions, for n from 2 to 10, and the shares of repeated lines and paragraphs."""

    @F.pandas_udf("array<double>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(fractions)

    return df.withColumn("_grams", udf(F.coalesce(F.col(text_col), F.lit(""))))


def top(n: int) -> Column:
    return F.element_at("_grams", n - 1)


def duplicate(n: int) -> Column:
    return F.element_at("_grams", len(SIZES) + n - 1)


def reason(text: Column) -> Column:
    """The first repetition rule that a text breaks: lines, paragraphs, top n-grams, duplicate n-grams; needs ``_grams``."""
    share = lambda k: F.element_at("_grams", 2 * len(SIZES) + k)
    out = F.when(share(1) > 0.30, "dup_line_fraction").when(share(2) > 0.30, "dup_para_fraction").when(T.strip(T.text_of(text)) == "", "empty")
    for n, limit in TOP_LIMITS.items():
        out = out.when(top(n) > limit, f"top_{n}gram_fraction")
    for n, limit in DUPLICATE_LIMITS.items():
        out = out.when(duplicate(n) > limit, f"dup_{n}gram_fraction")
    return out
