"""Patterns of personal information, masked one type after the other."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Type, pattern and placeholder, in the order in which they are applied.
PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("phone_us", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    ("ip_v4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_ADDRESS]"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[CREDIT_CARD]"),
    ("ssn", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0{4})\d{4}\b", "[SSN]"),
]


def masked(df: DataFrame, text_col: str = "text", max_density: float = 0.3, mode: str = "mask") -> DataFrame:
    """Adds ``masked_text``, ``n_<type>`` (matches in the text as masked so far), ``n_pii``, ``pii_density`` and ``pii_action``.

    The action is ``kept`` without a match, ``filtered`` in mode ``filter``,
    ``filtered_high_density`` beyond ``max_density`` matches a word of the original text,
    else ``masked``. A null text is an empty one.
    """
    df = df.withColumn("masked_text", T.text_of(F.col(text_col)))
    for name, pattern, placeholder in PATTERNS:
        df = df.withColumn(f"n_{name}", F.regexp_count("masked_text", F.lit(pattern))).withColumn("masked_text", F.regexp_replace("masked_text", pattern, placeholder.replace("$", r"\$")))
    total: Column = sum((F.col(f"n_{name}") for name, _, _ in PATTERNS[1:]), F.col(f"n_{PATTERNS[0][0]}"))
    density = T.ratio(F.col("n_pii"), T.n_words(F.col(text_col)))
    action = F.when(F.col("n_pii") == 0, "kept").when(F.lit(mode == "filter"), "filtered").when(F.col("pii_density") > max_density, "filtered_high_density").otherwise("masked")
    return df.withColumn("n_pii", total).withColumn("pii_density", density).withColumn("pii_action", action)
