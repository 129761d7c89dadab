"""Rewriting salvageable texts: a deterministic rewriter, and the gates around any rewriter."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.scorers import language as L
from gristmill.scorers import linear

#: Words that a text must have before and after; score that the result must reach.
MIN_BEFORE, MIN_AFTER, MIN_SCORE = 30, 20, 0.4
#: Lines of fewer words are taken for boilerplate.
LINE_WORDS = 4


def without_boilerplate(c: Column, min_words: int = LINE_WORDS) -> Column:
    """The solid lines of at least ``min_words`` words, stripped, one to a line."""
    return F.array_join(F.filter(T.solid_lines(c), lambda x: F.regexp_count(x, F.lit(f"{T.WS}+")) + 1 >= min_words), "\n")


def rewritten(df: DataFrame, text_col: str = "text", rewriter: Callable[[Column], Column] = without_boilerplate, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with ``new_text``, ``new_score`` and ``rewrite_status``.

    The status is the first gate that fails: ``too_short`` before, ``empty_result`` (too few
    words after), ``lang_mismatch``, ``quality_filtered``; else ``success``. ``new_text``
    and ``new_score`` are null for texts that are too short to be rewritten at all. The
    rewriter is a function of a column; one that calls a service wraps a pandas UDF.
    """
    score = score or (lambda m: T.let(m, lambda x: F.greatest(*[linear.score(n, {k: x[k] for k in linear.FEATURES}) for n in ("edu", "reference", "wiki")])))
    c = F.col(text_col)
    df = df.withColumn("new_text", F.when(T.n_words(c) >= MIN_BEFORE, rewriter(c)))
    new = F.col("new_text")
    df = df.withColumn("new_score", F.when(new.isNotNull(), score(linear.measured(new))))
    status = F.when(new.isNull(), "too_short").when(T.n_words(new) < MIN_AFTER, "empty_result").when(L.detected(c)["lang"] != L.detected(new)["lang"], "lang_mismatch")
    return df.withColumn("rewrite_status", status.when(F.col("new_score") < MIN_SCORE, "quality_filtered").otherwise("success"))
