"""The rule cascade as one plan: every row gets the first step and reason that drops it."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import dedup, ngrams, pii, quality
from gristmill.scorers import language as L
from gristmill.scorers import toxicity

#: The steps in their order; a step only sees what earlier ones leave.
STEPS = ("url_dedup", "url_filter", "lang", "quality", "repetition", "pii_density", "toxicity")


def language(col: Column) -> Column:
    """Code without country, in lower case; ``unknown`` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(col)), "^([a-z]+)", 1), F.lit("")), F.lit("unknown"))


def judged(texts: Column) -> Column:
    """Quality reason and, of what passes, the n-gram fractions, by one Arrow function; nulls for a null text."""

    @F.pandas_udf("q string, g array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        q = [None if t is None else quality.row_reason(t) for t in s]
        return pd.DataFrame({"q": q, "g": [None if t is None or r else ngrams.fractions(t) for t, r in zip(s, q)]})

    return run(texts)


def whole(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, url_col: str | None = "url", target: str = "en", max_density: float = 0.3, action: str = "filter") -> DataFrame:
    """``df`` with ``detected_lang``, ``lang_conf``, ``step``, ``reason``, ``masked_text``, ``n_pii`` and ``toxicity``.

    Steps: copies of an address (the row of the least id stays; rows without an address go
    by their content), the address filter, language (detected, or taken from ``lang_col``
    and then sure), quality, repetition, density of personal information, toxicity of the
    masked text. ``reason`` begins with the step and is null for what stays; only that has
    ``masked_text``. Dear measures are only made of rows that earlier steps leave. Without
    ``url_col`` the two steps by address are left out; with ``action='flag'`` toxicity
    never drops. A null text is an empty one; a null id has no copies. Ids must be unique.
    """
    known = L.detected(F.col(text_col)) if lang_col is None else F.struct(language(F.col(lang_col)).alias("lang"), F.lit(1.0).alias("conf"))
    early = F.lit(None).cast("string")
    if url_col is not None:
        copies = dedup.removed(df.select(id_col, url_col, text_col), dedup.url_key(F.col(url_col), F.col(text_col)), id_col).withColumn("_copy", F.lit(True))
        few = copies.limit(dedup.BROADCAST_IDS + 1).count() <= dedup.BROADCAST_IDS  # else the texts are shuffled by id
        df = df.join(F.broadcast(copies) if few else copies, id_col, "left")
        early = F.when(F.col("_copy"), "url_dedup:copy").otherwise(F.concat(F.lit("url_filter:"), quality.url(F.col(url_col))))
    df = df.withColumn("_l", T.fixed(known)).withColumn("_early", T.fixed(F.coalesce(early, F.concat(F.lit("lang:"), L.reason(F.col("_l.lang"), F.col("_l.conf"), target)))))
    df = df.withColumn("_j", judged(F.when(F.col("_early").isNull(), T.text_of(F.col(text_col)))))
    df = df.withColumn("_grams", F.col("_j.g")).withColumn("_early", F.coalesce("_early", F.concat(F.lit("quality:"), F.col("_j.q"))))
    df = df.withColumn("_early", T.fixed(F.coalesce("_early", F.when(F.col("_grams").isNotNull(), F.concat(F.lit("repetition:"), ngrams.reason(F.col(text_col)))))))
    df = pii.masked(df.withColumn("_text", F.when(F.col("_early").isNull(), F.col(text_col))), "_text", max_density)
    df = df.withColumn("_tox", F.when(F.col("_early").isNull(), toxicity.scored(F.col("masked_text")))).withColumn("toxicity", F.col("_tox.toxicity"))
    late = [F.when(F.col("pii_action").startswith("filtered"), F.concat(F.lit("pii_density:"), F.col("pii_action")))]
    if action == "filter":
        late.append(F.when(F.col("_early").isNull() & toxicity.is_toxic(F.col("toxicity"), F.col("_tox.severe_toxicity")), "toxicity:score"))
    df = df.withColumn("reason", T.fixed(F.coalesce("_early", *late))).withColumn("step", F.split_part("reason", F.lit(":"), F.lit(1)))
    df = df.withColumn("masked_text", F.when(F.col("reason").isNull(), F.col("masked_text"))).withColumn("detected_lang", F.col("_l.lang")).withColumn("lang_conf", F.col("_l.conf"))
    return df.drop("_copy", "_l", "_early", "_j", "_grams", "_text", "_tox")


def step_statistics(df: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """``step, before, after, filtered, filter_rate`` from the steps, in one pass; a step that drops nothing has a row, too."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col("step") == s, F.lit(False))).alias(s) for s in steps])
    before = F.col("total")
    rows = []
    for s in steps:
        rows.append(F.struct(F.lit(s).alias("step"), before.alias("before"), (before - F.col(s)).alias("after"), F.col(s).alias("filtered"), F.round(F.when(before > 0, F.col(s) / before).otherwise(0.0), 6).alias("filter_rate")))
        before = before - F.col(s)
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
