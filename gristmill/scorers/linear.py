"""Learned quality scores over a few dense measures of a text: logistic regressions, fitted here and stored.

The measures are made in Arrow batches in the pass that reads the texts anyway, the scores
are column expressions over them, and SQL can follow both. ``fit`` gives the coefficients; STORED holds
those that ``python -m gristmill.scorers.linear FOLDER`` printed.
"""
from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T

FEATURES = ("alpha", "stop", "log_words", "sentence", "special", "length", "digits")


_STOP = frozenset(T.STOP_WORDS)
_ENDS = re.compile("[.!?]+")


def row_measures(t: str | None) -> tuple[float, ...]:
    """The measures of one text, in the order of FEATURES; of no text all are 0."""
    t = t or ""
    ws = t.split()
    chars, n = len(t), len(ws)
    letters = digits = marks = 0
    for c, k in Counter(t).items():
        if c.isalpha():
            letters += k
        elif not c.isspace():
            if "0" <= c <= "9":
                digits += k
            elif unicodedata.category(c)[0] != "N":
                marks += k
    stops = sum([w.strip(".,!?;:'\"") in _STOP for w in t.lower().split()])
    sentences = [k for k in [len(p.split()) for p in _ENDS.split(t)] if k]
    mean = sum(sentences) / len(sentences) if sentences else 0.0
    return (letters / chars if chars else 0.0, stops / n if n else 0.0, math.log(n + 1), min(mean, 100.0) / 100, marks / chars if chars else 0.0, (sum(map(len, ws)) / n if n else 0.0) / 10, digits / chars if chars else 0.0)


def measured(c: Column) -> Column:
    """A struct of FEATURES: share of letters, of stop words, log of the words, words of a sentence (100 at most, a hundredth), share of marks, mean length of a word (a tenth), share of digits.

    An Arrow function: counted once for each distinct character of a text, it took a third
    of the time of regular expressions over columns (10,000 documents: about 1 s against 3 s).
    """

    @F.pandas_udf(", ".join(f"{k} double" for k in FEATURES))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row_measures(t) for t in s], columns=list(FEATURES))

    return run(T.text_of(c))


def features(c: Column) -> dict[str, Column]:
    """The fields of ``measured``."""
    m = measured(c)
    return {k: m[k] for k in FEATURES}


#: Stored models: the constant, then a coefficient for each measure. ``edu``: rows a labeller scored 3 or more against 1 or less;
#: ``reference``: encyclopedia abstracts and textbook samples against crawled documents; ``wiki``: abstracts alone against them;
#: ``evaluation``, never used to filter: textbook samples against crawled documents of odd ids.
STORED = {
    "edu": [0.9289, 3.0934, 2.9505, 0.0083, -4.2817, -12.9015, 0.0923, -24.4367],
    "reference": [-11.117, 9.3894, 7.2862, 0.0425, -1.0488, -26.2495, -0.0753, -15.9947],
    "wiki": [26.2963, -19.4711, 6.2266, -2.8026, 0.6733, -34.5875, -0.7112, -51.7739],
    "evaluation": [-27.5235, 16.6115, 8.9114, 1.8437, -2.642, -29.2368, -0.0056, 5.6705],
}


def score(name: str, measures: dict[str, Column]) -> Column:
    """The probability of the good class, to four places."""
    w = STORED[name]
    z = F.lit(w[0])
    for f, x in zip(FEATURES, w[1:]):
        z = z + measures[f] * x
    return F.round(1 / (1 + F.exp(-z)), 4)


def with_scores(df: DataFrame, text_col: str = "text", names: tuple[str, ...] = ("edu", "reference", "wiki", "evaluation")) -> DataFrame:
    """``df`` with a column ``score_<name>`` for each model; null and empty texts are scored as texts without words."""
    df = df.withColumn("_f", T.fixed(measured(F.col(text_col))))
    known = {k: F.col(f"_f.{k}") for k in FEATURES}
    return df.withColumns({f"score_{n}": score(n, known) for n in names}).drop("_f")


def fit(df: DataFrame, label: str = "label", text_col: str = "text") -> list[float]:
    """Constant and coefficients of a ridge logistic regression over all rows of ``df``, distributed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(label).cast("double").alias("label"), *[v.alias(k) for k, v in features(F.col(text_col)).items()])
    model = LogisticRegression(regParam=0.003, maxIter=100).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return [round(float(x), 4) for x in (model.intercept, *model.coefficients)]


def training_sets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``text, label`` of each model."""
    from gristmill.scorers.quality import labels
    from gristmill.sources.tables import table

    docs = table(spark, folder, "documents").select("doc_id", "text", "title", "prompt", "url")
    crawled = docs.where("title IS NULL AND prompt IS NULL AND url IS NOT NULL").select("doc_id", "text", F.lit(0).alias("label"))
    good = lambda cond: docs.where(cond).select("doc_id", "text", F.lit(1).alias("label"))
    edu = table(spark, folder, "gen1_output").select("rec_id", "text").join(F.broadcast(labels(table(spark, folder, "llm_labels"))), "rec_id")  # 20,000 labels at most
    return {
        "edu": edu, "reference": good("title IS NOT NULL OR prompt IS NOT NULL").unionByName(crawled), "wiki": good("title IS NOT NULL").unionByName(crawled),
        "evaluation": good("prompt IS NOT NULL").unionByName(crawled.where("doc_id % 2 = 1")),
    }


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").getOrCreate()
    for key, rows in training_sets(session, sys.argv[1]).items():
        print(f'    "{key}": {fit(rows)},')
