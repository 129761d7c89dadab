"""Repetition inside one text (problem 6).

Every word of a text is an event of a multinomial over hashed n-grams: the bucket of the
pair of words that begins there, together with how the runs of four words over it occur in
the same text (once only, or again). One multinomial is estimated over all rows, the raw
corpus, one over the trusted target (rows a labeller scored well), mixed with the raw one so
that nothing has probability 0. The log-likelihood ratio of a text between target and raw,
divided by its number of words, is what every text is judged by: one fixed cut for all, the
ratio that words of the corpus would give on average if the limit share of them came again.
The share itself, counted exactly over the words, is reported beside it.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import lex
from gristmill.operators.components import checkpointed
from gristmill.sources.tables import spread

#: Buckets of hashed pairs; weight of the raw corpus in the target; events added to the target's.
BUCKETS, MIX = 1 << 12, 0.01
PRIOR = 16 * BUCKETS
LENGTH = 4


def exact_repeated(ws: list[str], n: int = LENGTH) -> int:
    """Words that lie in a run of ``n`` words occurring more than once in ``ws``."""
    grams: dict[tuple, list[int]] = {}
    for i, g in enumerate(zip(*(ws[k:] for k in range(n)))):
        grams.setdefault(g, []).append(i)
    covered = set()
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + n))
    return len(covered)


def hashed_events(docs: list[list[str]], cache: lex.Hashes, n: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The event of every word of ``docs`` in one array, and where each document begins (one more entry at the end).

    An event is twice the bucket of the pair of words that begins there (the last word of a
    text is paired with nothing), plus one where a hashed run of ``n`` words over the word
    occurs more than once in the text.
    """
    flat, starts = lex.flat_hashes(docs, cache)
    lengths = np.diff(starts)
    total = len(flat)
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
    after = np.zeros_like(flat)
    if total > 1:
        after[:-1] = np.where(doc[1:] == doc[:-1], flat[1:], 0)
    pair = lex.mix(lex.mix(flat + np.uint64(0x9E3779B97F4A7C15)) ^ after)
    events = (pair & np.uint64(BUCKETS - 1)).astype(np.int64) * 2
    if total >= n:
        m = total - n + 1
        h = flat[:m].copy()
        for k in range(1, n):
            h = lex.mix(h + np.uint64(0x9E3779B97F4A7C15)) ^ flat[k : m + k]
        h = lex.mix(h ^ lex.mix(doc[:m].astype(np.uint64) + np.uint64(1)))
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        order = np.argsort(h[at], kind="stable")
        same = h[at][order]
        same = same[1:] == same[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.bincount(at[twice], minlength=total + 1) - np.bincount(at[twice] + n, minlength=total + 1)
        events += np.cumsum(cover[:-1]) > 0
    return events, starts


def _read(pdfs):
    cache = lex.Hashes()
    for pdf in lex.batches(pdfs):
        docs = [lex.words(t) for t in pdf["text"]]
        events, starts = hashed_events(docs, cache)
        again = np.concatenate([[0], np.cumsum(events & 1)])
        again = again[starts[1:]] - again[starts[:-1]]
        small = events.astype(np.uint16)
        yield pd.DataFrame({
            "table_name": pdf["table_name"], "row_id": pdf["row_id"], "n_words": np.diff(starts).astype(np.int32),
            "events": [small[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], "repeated": [exact_repeated(ws) if r else 0 for ws, r in zip(docs, again)],
        })


def _counts(pdfs):
    sums = np.zeros(2 * BUCKETS, np.int64)
    for pdf in lex.batches(pdfs):
        sums += np.bincount(np.frombuffer(b"".join(pdf["events"]), np.uint16), minlength=2 * BUCKETS)
    at = np.flatnonzero(sums)
    yield pd.DataFrame({"event": at, "n": sums[at]})


def _scores(ratio: np.ndarray):
    def run(pdfs):
        for pdf in lex.batches(pdfs):
            n = pdf["n_words"].to_numpy()
            at = np.repeat(np.arange(len(pdf)), n)
            llr = np.bincount(at, ratio[np.frombuffer(b"".join(pdf["events"]), np.uint16)], minlength=len(pdf)) / np.maximum(n, 1)
            yield pd.DataFrame({"table_name": pdf["table_name"], "row_id": pdf["row_id"], "n_words": n, "llr": llr, "repeated_share": pdf["repeated"].to_numpy() / np.maximum(n, 1)})

    return run


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of each event between the target and the raw corpus; 0 for events that don't occur.

    Buckets that the target knows little of go by the raw corpus: ``PRIOR`` events are
    added, with the target's rate of words that come again and the raw corpus' buckets.
    """
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p, kinds = raw / raw.sum(), raw.reshape(-1, 2)
    prior = (kinds / np.maximum(kinds.sum(axis=0), 1) * target.reshape(-1, 2).sum(axis=0) / target.sum()).reshape(-1)
    q = (target + PRIOR * prior) / (target.sum() + PRIOR)
    seen = raw > 0
    return np.where(seen, np.log(np.where(seen, (1 - MIX) * q + MIX * p, 1.0) / np.where(seen, p, 1.0)), 0.0)


def cut_at(raw: np.ndarray, ratio: np.ndarray, share: float) -> float:
    """The mean ratio of a text of which ``share`` of the words come again, its words otherwise as those of the corpus."""
    fresh, again = raw[::2], raw[1::2]
    mean = lambda n, r: float((n * r).sum() / n.sum()) if n.sum() else 0.0
    return share * mean(again, ratio[1::2]) + (1 - share) * mean(fresh, ratio[::2])


def repetition(rows: DataFrame, trusted: DataFrame, limit: float = 0.3, min_words: int = 5) -> DataFrame:
    """``table_name, row_id, n_words, llr, repeated_share, is_repetitive`` for every row of ``(table_name, row_id, text)``.

    ``trusted`` holds ``table_name, row_id`` of trusted rows, which all make the target; of
    these only texts without any repeated run count, as labels are noisy. A null or empty
    text has no words, a share and a ratio of 0 and isn't flagged, nor is a text of fewer
    than ``min_words`` words. Without trusted rows the target is made of all texts that have
    no repeated run. Ids may be null; repeated ids stay separate rows.
    """
    rows = spread(rows.select("table_name", "row_id", F.coalesce("text", F.lit("")).alias("text")), "row_id")
    events = checkpointed(rows.mapInPandas(_read, "table_name string, row_id bigint, n_words int, events binary, repeated bigint"))

    def counted(some: DataFrame) -> np.ndarray:
        c = some.select("events").mapInPandas(_counts, "event bigint, n bigint").groupBy("event").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(2 * BUCKETS)
        out[c["event"]] = c["n"]
        return out  # two numbers a bucket, whatever the size of the corpus

    raw = counted(events)
    clean = events.where("repeated = 0").select("table_name", "row_id", "events")
    # trusted rows grow with the corpus: events (two bytes a word) are shuffled to them, they aren't broadcast
    target = counted(clean.join(trusted.select("table_name", "row_id").hint("merge"), ["table_name", "row_id"], "left_semi"))
    if not target.sum():
        target = counted(clean)
    ratio = log_ratios(raw, target)
    scored = events.select("table_name", "row_id", "n_words", "events", "repeated").mapInPandas(_scores(ratio), "table_name string, row_id bigint, n_words int, llr double, repeated_share double")
    # where nothing comes again in the whole corpus, no ratio tells anything
    known_again = bool(raw[1::2].sum() and target.sum())
    return scored.withColumn("is_repetitive", F.lit(known_again) & (F.col("n_words") >= min_words) & (F.col("llr") <= cut_at(raw, ratio, limit)))
