"""Measures of a corpus: diversity, entropy, distributions, classifier quality, cuts and routes."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T


def hash_order(seed: int, *ids: str) -> Column:
    """An order by chance that is the same in every run and in SQL."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def word_ngrams(text: Column, n: int) -> Column:
    """Runs of n lower-case words; none of a text that is too short.

    Made of n shifted copies of the words: a lambda over places would split the text anew for each of them.
    """
    w = T.words(F.lower(text))
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(out, lambda g: g.isNotNull())


def ngram_counts(df: DataFrame, sizes: tuple[int, ...], text_col: str = "text") -> DataFrame:
    """``n, gram, c`` over all texts; n-grams never reach over the end of a text."""
    per = F.array(*[F.struct(F.lit(n).alias("n"), word_ngrams(F.col(text_col), n).alias("g")) for n in sizes])
    rows = df.select(F.explode(per).alias("s")).select("s.n", F.explode("s.g").alias("gram"))
    return rows.groupBy("n", "gram").agg(F.count("*").alias("c"))


class _Words(dict):
    """word -> 64-bit hash, the same in every process; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed_ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """For each of ``sizes`` (ascending) the 64-bit hashes of the runs of so many lower-case words; empty for a text that is too short.

    An Arrow function: a text's words are hashed once and the hashes mixed by arrays, where
    expressions over arrays of words would make every n-gram as a string.
    """

    @F.pandas_udf("array<array<bigint>>")
    def run(s: pd.Series) -> pd.Series:
        known = _Words()
        out = []
        for t in s:
            h = np.array([known[w] for w in t.lower().split()] if t else [], dtype=np.uint64)
            gram, made, at = h, [], 1
            for n in sizes:
                while at < n:
                    gram = _mixed(gram[: max(0, len(gram) - 1)] + np.uint64(0x9E3779B97F4A7C15)) ^ h[at:] if len(h) > at else h[:0]
                    at += 1
                made.append(gram.view(np.int64))
            out.append(made)
        return pd.Series(out)

    return run(text)


def ngram_diversity(df: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4), text_col: str = "text") -> DataFrame:
    """``n, n_unique, n_total, diversity``. Counts of hashed n-grams: 64 bits a gram are shuffled, partly summed before."""
    rows = df.select(F.posexplode(hashed_ngrams(F.col(text_col), sizes)).alias("i", "g")).select("i", F.explode("g").alias("h"))
    counts = rows.groupBy("i", "h").agg(F.count("*").alias("c"))
    n = F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("i") + 1)
    return counts.groupBy(n.alias("n")).agg(F.count("*").alias("n_unique"), F.sum("c").alias("n_total")).withColumn("diversity", F.round(F.col("n_unique") / F.col("n_total"), 4))


def entropy(counts: DataFrame, key: str, c: str = "c", top: int = 50) -> DataFrame:
    """Shannon entropy in bits over the ``top`` most frequent keys, their shares taken among themselves; ties by key.

    ``n_keys`` counts all keys; ``normalized`` is by the most that so many keys can have.
    """
    head = counts.orderBy(F.desc(c), F.asc(key)).limit(top)
    total = head.agg(F.sum(c).alias("_t"), F.count("*").alias("_k"))
    share = F.col(c) / F.col("_t")
    bits = head.select(c).crossJoin(F.broadcast(total)).agg((-F.sum(share * F.log2(share))).alias("_e"), F.max("_k").alias("_k"))  # one row against at most ``top``
    every = counts.agg(F.count("*").alias("n_keys"))
    out = bits.crossJoin(F.broadcast(every))  # one row each
    most = F.when(F.col("_k") > 1, F.log2("_k"))
    return out.select(F.round("_e", 4).alias("entropy"), F.round(F.coalesce(most, F.lit(0.0)), 4).alias("max_entropy"), F.round(F.coalesce(F.col("_e") / most, F.lit(0.0)), 4).alias("normalized"), "n_keys")


def distribution(x: Column, qs: tuple[float, ...]) -> list[Column]:
    return [F.round(F.percentile(x, F.lit(q)), 6).alias(f"p{round(q * 100)}") for q in qs]


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bin, n`` of equal widths between the least and the greatest value, the last bin closed; empty bins with 0."""
    span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    rows = df.where(F.col(col).isNotNull()).select(col).crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = rows.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def mean_of_scores(score: str) -> Column:
    """The mean of scores of four places, the same in any order of rows.

    Ten-thousandths are summed as whole numbers: sums of doubles take up an error by their
    order, and with a few hundred rows a mean often lies halfway between two of six places.
    """
    return F.sum(F.round(F.col(score) * 10_000).cast("bigint")) / 10_000 / F.count(score)


def top_fraction(df: DataFrame, score: str, fraction: float) -> DataFrame:
    """Rows whose score reaches the percentile of ``1 - fraction``; ties at the threshold all stay. Adds ``threshold``."""
    cut = df.agg(F.percentile(score, F.lit(1 - fraction)).alias("threshold"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("threshold"))  # one row


def route(score: Column) -> Column:
    return F.when(score >= 0.7, "high_quality").when(score >= 0.3, "medium_quality").when(score >= 0.1, "to_rephrase").otherwise("discarded")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``roc_auc, pr_auc, n_pos, n_neg``, ties shared out, from counts by distinct score.

    Scores are taken to four places, as they are stored: counts are made by score before
    anything is ordered, and the running totals go over these few thousand rows.
    """
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.round(score, 4).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    w = Window.orderBy(F.desc("s"))
    run = by.select("s", "p", "q", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))
    total = by.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    run = run.crossJoin(F.broadcast(total))  # one row
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.max("np") * F.max("nq"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    last = F.coalesce(F.lag(precision).over(w), F.lit(1.0))
    steps = run.withColumn("step", F.col("p") / F.col("np") * (precision + last) / 2)
    return steps.agg(F.round(area, 6).alias("roc_auc"), F.round(F.sum("step"), 6).alias("pr_auc"), F.max("np").alias("n_pos"), F.max("nq").alias("n_neg"))
