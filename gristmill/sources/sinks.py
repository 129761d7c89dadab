"""What the pipelines write: documents, statistics, audits, routes, token arrays, labels."""
from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an audit, in order.
AUDIT = ("filter_name", "text_preview", "text_length_words", "url", "filter_reason", "human_label", "human_comment")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; characters beyond ASCII stay, null fields are left out."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """The seven columns of an audit; those that ``df`` lacks are empty, to be filled in by hand."""
    write_csv(df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in AUDIT]), path)


def write_routed(df: DataFrame, path: str, route_col: str = "route") -> None:
    """Documents by route, one folder each, so that a reader of one route opens no file of the others."""
    df.write.mode("overwrite").partitionBy(route_col).parquet(path)


def statistics(**frames: DataFrame) -> str:
    """Small frames (reports of few rows) as one JSON text, by name."""
    return json.dumps({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in frames.items()}, ensure_ascii=False, default=str)


def write_statistics(df: DataFrame, path: str, **frames: DataFrame) -> None:
    """``statistics`` as a file beside the documents, written by the session of ``df``."""
    spark = df.sparkSession
    spark.createDataFrame([(statistics(**frames),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def token_arrays(df: DataFrame, encode: Callable[[str], list[int]], id_col: str = "doc_id", text_col: str = "text", max_len: int = 512, end: int = 0) -> DataFrame:
    """``id, tokens`` with at most ``max_len`` tokens of each text and the end mark after them; a null text is only the mark.

    ``encode`` is called inside the tasks; cutting at ``max_len`` is the format's own rule.
    """
    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({id_col: pdf[id_col], "tokens": [[*(encode(t)[:max_len] if t else []), end] for t in pdf[text_col]]})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, tokens array<int>")


def add_labels(new: DataFrame, path: str, id_col: str = "rec_id") -> None:
    """Appends labels to the cache at ``path``; ids that it holds already are left out."""
    spark = new.sparkSession
    try:
        old = spark.read.json(path).select(F.col(id_col).cast(dict(new.dtypes)[id_col]))
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    rows = new if old is None else new.join(old, id_col, "left_anti")
    write_jsonl(rows, path, "append")


def markdown(df: DataFrame) -> str:
    """A small report (a few rows) as a table in Markdown."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.collect())])
