"""Replies of services that label, judge or rewrite: parsing them, and calling such a service from tasks."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(reply: Column) -> Column:
    """The first digit from 0 to 5 of a reply; null without one."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit("([0-5])"), F.lit(1)), F.lit(1)).cast("int")


#: What a judge gives for each document.
JUDGEMENTS = "array<struct<doc_id:int,quality_score:double,quality_label:string,brief_reason:string>>"


def unfenced(reply: Column) -> Column:
    """The text inside of the first fenced block of a reply, or the reply itself."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.trim(F.when(F.contains(reply, F.lit("```")), inside).otherwise(reply))


def judgements(reply: Column) -> Column:
    """The judgements of a reply; one of score -1 and label ``error`` for a reply that is no such JSON."""
    bad = F.array(F.struct(F.lit(0).alias("doc_id"), F.lit(-1.0).alias("quality_score"), F.lit("error").alias("quality_label"), F.lit("unreadable reply").alias("brief_reason")))
    return F.coalesce(F.from_json(unfenced(reply), JUDGEMENTS, {"mode": "PERMISSIVE"}), bad.cast(JUDGEMENTS))


def asked(df: DataFrame, ask: Callable[[str], str], text_col: str = "text", retries: int = 3, delay: float = 1.0, out: str = "reply") -> DataFrame:
    """``df`` with ``out``, what ``ask`` answers to each text, and ``<out>_error``; called inside the tasks.

    A call that raises is tried again, waiting longer each time; after the last the reply is
    null and the error's text stands beside it. Limit the rate by the number of partitions.
    """
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            replies, errors = [], []
            for t in pdf[text_col]:
                reply = error = None
                for k in range(retries):
                    try:
                        reply, error = ask(t or ""), None
                        break
                    except Exception as e:  # the service's own errors
                        error = str(e)[:100]
                        if k + 1 < retries:
                            time.sleep(delay * (k + 1))
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(**{out: replies, f"{out}_error": errors})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInPandas(run, ", ".join([*fields, f"{out} string", f"{out}_error string"]))
