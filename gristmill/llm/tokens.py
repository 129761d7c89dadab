"""Token counts under an existing tokenizer, and their estimation (problem 3).

Per language a ridge regression predicts the tokens of a text from its bytes, words,
digits, punctuation and script counts. It is fitted on a bounded sample of texts that are
really tokenized; the bias that remains is taken off by the ratio of true to predicted
totals on tokenized texts that were held out. The fitted formula is one column expression,
so that the other texts are never tokenized and never leave the JVM.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.urls import domain
from gristmill.llm import lex

TOKENIZERS = "/opt/tokenizers"
#: Tokenized texts per language, every second one held out.
SAMPLE = 400
LANGUAGES = ("en", "de", "fr", "es", "zh", "other")
#: Fixed value: the pattern that splits text before byte-pair merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FEATURES = ("bytes", "words", "digits", "punctuation", "wide", "han")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS):
    """The byte-pair encoding in ``folder``, loaded once per process."""
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts, folder: str = TOKENIZERS) -> list[int]:
    enc = encoding(folder)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def language(col: Column) -> Column:
    """A language code without country and case; one of LANGUAGES."""
    base = F.regexp_extract(F.lower(F.trim(col)), "^([a-z]+)", 1)
    return F.when(base.isin(*LANGUAGES[:-1]), base).otherwise("other")


def features(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def without(chars: str) -> Column:
        return n - F.length(F.translate(t, chars, ""))

    han = n - F.length(F.regexp_replace(t, f"[{lex.HAN}]", ""))
    wide = F.octet_length(t) - n
    return [F.octet_length(t), without(" \n\t"), without("0123456789"), without(_PUNCTUATION), wide, han]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "_detected_lang", id_col: str = "rec_id", sample: int = SAMPLE, folder: str = TOKENIZERS) -> dict[str, np.ndarray]:
    """Coefficients by language for (1, *FEATURES), corrected by held-out texts.

    A language of fewer than 20 tokenized texts takes the coefficients of all together.
    """
    from pyspark.sql import Window

    base = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(language(F.col(lang_col)).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    # the least hashes by language, found without moving texts; then only those texts
    top = base.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample).select("lang", "h").distinct()
    rows = base.join(F.broadcast(top), ["lang", "h"], "left_semi").select("lang", "h", "text", *[f.cast("double").alias(n) for f, n in zip(features(F.col("text")), FEATURES)]).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    true = np.array(count_tokens([r["text"] for r in rows], folder), dtype=float)
    x = np.array([[1.0, *[r[f] for f in FEATURES]] for r in rows]).reshape(len(rows), 1 + len(FEATURES))
    lang = np.array([r["lang"] for r in rows])

    def solve(at: np.ndarray) -> np.ndarray:
        train, held = at[::2], at[1::2]
        a = x[train]
        w = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ true[train])
        predicted = (x[held] @ w).sum()
        return w * (true[held].sum() / predicted if predicted > 0 and true[held].sum() > 0 else 1.0)

    everything = np.arange(len(rows))
    whole = solve(everything) if len(rows) else np.array([0.0, 0.25, *[0.0] * (len(FEATURES) - 1)])
    return {la: solve(everything[lang == la]) if (lang == la).sum() >= 20 else whole for la in LANGUAGES}


def estimated(text: Column, lang: Column, model: dict[str, np.ndarray]) -> Column:
    """The estimated number of tokens of ``text``; 0 for a null or empty one."""
    fs = features(text)

    def formula(w: np.ndarray) -> Column:
        out = F.lit(float(w[0]))
        for c, f in zip(w[1:], fs):
            out = out + f * float(c)
        return out

    code = language(lang)
    e = F.when(code == LANGUAGES[0], formula(model[LANGUAGES[0]]))
    for la in LANGUAGES[1:-1]:
        e = e.when(code == la, formula(model[la]))
    e = e.otherwise(formula(model["other"]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.greatest(e, F.lit(1.0)))


def token_budget(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``source, lang, domain, n_docs, est_tokens`` of ``(text, source, _detected_lang, url)``; missing values count as ``unknown``."""
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown"))
    host = F.coalesce(F.nullif(domain(F.col("url")), F.lit("")), F.lit("unknown"))
    rows = docs.select(source.alias("source"), language(F.col("_detected_lang")).alias("lang"), host.alias("domain"), estimated(F.col("text"), F.col("_detected_lang"), model).alias("t"))
    return rows.groupBy("source", "lang", "domain").agg(F.count("*").alias("n_docs"), F.round(F.sum("t")).cast("bigint").alias("est_tokens"))


def implausible_runs(docs: DataFrame, metrics: DataFrame, model: dict[str, np.ndarray], factor: float = 2.0) -> DataFrame:
    """``run_id, segment, stated, est_tokens`` of stated totals off by more than ``factor`` from the texts of their segment."""
    sums = docs.groupBy("segment").agg(F.sum(estimated(F.col("text"), F.col("_detected_lang"), model)).alias("t"))
    stated = metrics.where("stage = 'gen1_output' AND estimated_total_tokens IS NOT NULL").select("run_id", "segment", F.col("estimated_total_tokens").alias("stated"))
    both = stated.join(sums, "segment", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    return both.where((F.col("stated") * factor < F.col("t")) | (F.col("stated") > F.col("t") * factor)).select("run_id", "segment", "stated", F.round("t").cast("bigint").alias("est_tokens"))
