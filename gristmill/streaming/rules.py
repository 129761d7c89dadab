"""The cascade, deduplication and windowed counts over streams."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import cascade, dedup


def stream_reasons(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", url_col: str | None = None) -> DataFrame:
    """The cascade on a stream, row by row: every row with ``step``, ``reason`` and ``masked_text``, as in batch.

    Copies of an address need a state, which ``stream_dedup`` keeps; here ``url_col`` only
    serves the address filter.
    """
    out = cascade.whole(docs, id_col, text_col, lang_col, None)
    if url_col is None:
        return out
    from gristmill.operators import quality

    first = F.concat(F.lit("url_filter:"), quality.url(F.col(url_col)))
    out = out.withColumn("reason", F.coalesce(first, "reason")).withColumn("step", F.split_part("reason", F.lit(":"), F.lit(1)))
    return out.withColumn("masked_text", F.when(F.col("reason").isNull(), F.col("masked_text")))


def stream_dedup(docs: DataFrame, ts: str = "ts", late: str = "30 days", text_col: str = "text") -> DataFrame:
    """The first row of each content within the watermark; the state holds keys of 128 bits, not texts."""
    keyed = docs.withColumn("_key", dedup.content_key(F.col(text_col)))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_counts(docs: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "30 days", **columns) -> DataFrame:
    """Rows by step and window of event time, late rows up to the watermark included."""
    step = F.coalesce("step", F.lit("kept"))
    return stream_reasons(docs, **columns).withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), step.alias("step")).agg(F.count("*").alias("n"))
