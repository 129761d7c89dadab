"""Toxicity in six dimensions by small lexicons; a deterministic default behind the interface of a learned scorer."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Terms by dimension, as regular expressions over lower-case text.
TERMS = {
    "severe_toxicity": "motherfucker|cunt|kill yourself|filthy whore",
    "obscene": "fuck|fucking|shit|asshole|bitch|cunt|cock|bastard|motherfucker",
    "threat": "kill you|hurt you|beat you|shoot you|find you|kill yourself",
    "insult": "idiot|moron|stupid|loser|scum|pathetic|worthless",
    "identity_attack": "vermin|subhuman|inferior race|go back to your country|filthy foreigners",
}
DIMENSIONS = ("toxicity", *TERMS)
#: A text of n terms of a dimension scores 1 - KEEP ** n.
KEEP = 0.45


def scored(text: Column) -> Column:
    """A struct of 0 to 1 for each dimension; ``toxicity`` is the greatest of the others. A null text is blank and scores 0."""
    def each(t: Column) -> Column:
        return F.struct(*[F.round(1 - F.pow(F.lit(KEEP), F.regexp_count(t, F.lit(rf"\b(?:{p})\b"))), 4).alias(k) for k, p in TERMS.items()])

    return T.let(T.let(F.lower(T.text_of(text)), each), lambda x: F.struct(F.greatest(*[x[k] for k in TERMS]).alias("toxicity"), *[x[k].alias(k) for k in TERMS]))


def is_toxic(toxicity: Column, severe: Column, limit: float = 0.85, severe_limit: float = 0.50) -> Column:
    return F.coalesce(toxicity > limit, F.lit(False)) | F.coalesce(severe > severe_limit, F.lit(False))


def with_scores(df: DataFrame, text_col: str = "text", scorer: Callable[[list[str]], dict[str, list[float]]] | None = None, batch: int = 32) -> DataFrame:
    """``df`` with a column for each dimension, by the lexicons or by ``scorer``: texts in, lists of scores by dimension out.

    A scorer gets blank texts as one blank, ``batch`` texts at a time, and is called inside
    the tasks, so that it should load its model on first use.
    """
    if scorer is None:
        df = df.withColumn("_tox", scored(F.col(text_col)))
        return df.withColumns({d: F.col(f"_tox.{d}") for d in DIMENSIONS}).drop("_tox")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = [t if t and t.strip() else " " for t in pdf[text_col].fillna("")]
            made: dict[str, list[float]] = {d: [] for d in DIMENSIONS}
            for i in range(0, len(texts), batch):
                got = scorer(texts[i : i + batch])
                for d in DIMENSIONS:
                    made[d] += [round(float(x), 4) for x in got.get(d, [0.0] * len(texts[i : i + batch]))]
            yield pdf.assign(**made)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{d} double" for d in DIMENSIONS)])
    return df.mapInPandas(run, schema)


def filtered(df: DataFrame, action: str = "flag", **limits: float) -> DataFrame:
    """``df`` with ``is_toxic`` and ``toxicity_action``: ``kept``, or what ``action`` says: ``flag`` never drops, ``filter`` marks for dropping."""
    bad = is_toxic(F.col("toxicity"), F.col("severe_toxicity"), **limits)
    return df.withColumn("is_toxic", bad).withColumn("toxicity_action", F.when(~bad, "kept").otherwise("filtered" if action == "filter" else "flagged"))
