"""Keyword-stuffed and link-list pages (problem 10).

A text becomes a sequence of classes: function words and marks stand for themselves, links,
hashtags, numbers and ideographs for their kind, other words for their length, or, where
they stood a few tokens before, for "again" (a word the text is full of: "often"). Case is
folded. A trigram model of such sequences is counted over all texts that read as prose.
Every text is scored in windows of ``WINDOW`` tokens; a window whose perplexity is higher
or lower than that of nearly all windows of prose is abnormal, and a page whose windows are
mostly abnormal is flagged. No list of search words and no pattern of links decides.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import lex
from gristmill.operators.components import checkpointed
from gristmill.sources.tables import spread

#: Share of the windows of prose left out on each side of the normal range.
TAIL = 0.02
#: A page is flagged when more than this share of its windows is abnormal.
MIN_SHARE = 0.5
#: Tokens of a window; tokens after which a word counts as new again.
WINDOW, RECENT = 24, 30
BUCKETS = 1 << 20
#: Width and number of the bins in which perplexities of windows are counted.
BIN, BINS = 0.005, 4_000
#: Rows handled at once.
ROWS = 400

TOKEN = re.compile(rf"(?i:https?://|www\.)\S+|#\w+|[^\W\d_{lex.HAN}]+|\d+|[{lex.HAN}]|[^\w\s]|\n")
_MARKS = ".,;:!?|·»>-–()[]\"'/，。、！？；："
_HAN_MARKS = "，。！？；"
_HAN_WORDS = "的了在是和有不人我他这就也都到说没把被从因为如果已经最很会还那"
_LENGTHS = ("<w1>", "<w2>", "<w3>", "<w5>", "<w8>", "<w9>")
_KNOWN: dict[str, int] = {}
for _w in ["<begin>", "<url>", "<tag>", "<num>", *_LENGTHS, "<han>", "<sign>", "<again>", "<often>", "\n", *_MARKS, *_HAN_WORDS, *sorted(lex.COMMON)]:
    _KNOWN.setdefault(_w, len(_KNOWN))
N = len(_KNOWN)
_SHIFT = 40


def _flags(*names: str) -> np.ndarray:
    out = np.zeros(N, bool)
    out[[_KNOWN[n] for n in names]] = True
    return out


_CONTENT = _flags(*_LENGTHS)
_NO_WORD = _flags("<begin>", "<sign>", "\n", *_MARKS)
#: Per class and measure, 1 where the class counts: words, ideographs, their marks, function words, words again, links.
_MEASURES = np.stack([~_NO_WORD, _flags("<han>", *_HAN_WORDS), _flags(*_HAN_MARKS), _flags(*lex.COMMON), _flags("<again>", "<often>"), _flags("<url>", "<tag>")], axis=1).astype(np.int64)


class _Classes(dict):
    """token -> number of its class, shifted, and a hash of a content word."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        low = token.lower()
        if low in _KNOWN:
            c = _KNOWN[low]
        elif "://" in low or low.startswith("www."):
            c = _KNOWN["<url>"]
        elif token[0] == "#" and len(token) > 1:
            c = _KNOWN["<tag>"]
        elif token[0].isdigit():
            c = _KNOWN["<num>"]
        elif re.match(f"[{lex.HAN}]", token):
            c = _KNOWN["<han>"]
        elif not token[0].isalpha():
            c = _KNOWN["<sign>"]
        else:
            n = len(token)
            c = _KNOWN[f"<w{n if n < 4 else 5 if n < 6 else 8 if n < 9 else 9}>"]
        out = self[token] = c << _SHIFT | (hash(low) & ((1 << _SHIFT) - 1) if _CONTENT[c] else 0)
        return out


def sequences(cache: _Classes, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of ``texts`` in one array, and where each text begins (one more entry at the end)."""
    flat: list[int] = []
    starts = [0]
    get = cache.__getitem__
    for t in texts:
        flat.extend(map(get, TOKEN.findall(t)))
        starts.append(len(flat))
    x, begin = np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)
    ids, word = x >> _SHIFT, x & ((1 << _SHIFT) - 1)
    at = np.flatnonzero(word)
    if len(at):
        doc = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((at, word[at], doc))
        a, d, w = at[order], doc[order], word[at][order]
        new = np.ones(len(a), bool)
        new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        near = np.zeros(len(a), bool)
        near[1:] = ~new[1:] & (a[1:] - a[:-1] <= RECENT)
        full = count >= np.maximum(5, np.diff(begin)[d] // 50)
        ids[a[near]] = _KNOWN["<again>"]
        ids[a[near & full]] = _KNOWN["<often>"]
    return ids, begin


def reads_as_prose(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence, whether it belongs into the model (function words or marks of ideographs, few links, words mostly new), and whether it is of ideographs."""
    sums = np.concatenate([np.zeros((1, _MEASURES.shape[1]), np.int64), np.cumsum(_MEASURES[ids], axis=0)])
    words, han, marks, common, again, links = (sums[begin[1:]] - sums[begin[:-1]]).T
    is_han = han * 2 > words
    return (words >= 20) & np.where(is_han, marks >= 0.03 * words, common >= 0.18 * words) & (again <= 0.2 * words) & (links <= 0.03 * words), is_han


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the two classes before each position, and of the three that end there."""
    two = a.astype(np.uint64) * np.uint64(4099) + b.astype(np.uint64)
    three = two * np.uint64(4099) + c.astype(np.uint64)
    return (lex.mix(two) & np.uint64(BUCKETS - 1)).astype(np.int64), (lex.mix(three) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _before(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second last and the last class before each position; the beginning before a text."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    first = begin[:-1][np.diff(begin) > 0]
    one[first] = two[first] = 0
    second = begin[:-1][np.diff(begin) > 1] + 1
    two[second] = 0
    return two, one


class Model:
    """Interpolated trigram model of class sequences, from counts by table and place; of a size that doesn't depend on the corpus."""

    def __init__(self, table: np.ndarray, place: np.ndarray, count: np.ndarray):
        made = []
        for k, size in enumerate((N, N * N, BUCKETS, BUCKETS)):
            x = np.zeros(size)
            x[place[table == k]] = count[table == k]
            made.append(x)
        one = made[0] + 1
        two = made[1].reshape(N, N) + 0.02
        self.below = (0.3 * two / two.sum(axis=1, keepdims=True) + 0.1 * one / one.sum()).astype(np.float32)
        # counts of a large corpus are beyond what 32 bits hold exactly
        self.pair, self.triple = made[2], made[3]

    def surprise(self, ids: np.ndarray, begin: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Negative log-probability of every class; texts of the model (``known``) are scored by the rest of the corpus, their own count taken away."""
        a, b = _before(ids, begin)
        two, three = _keys(a, b, ids)
        triple, pair = self.triple[three], self.pair[two]
        if known is not None:
            less = np.repeat(known, np.diff(begin)).astype(float)
            triple, pair = np.maximum(triple - less, 0), pair - less
        return -np.log(0.6 * triple / np.maximum(pair, 1) + self.below[b, ids])

    def windows(self, ids: np.ndarray, begin: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-perplexity of every window, and how many windows each text has; an empty text has none."""
        n = np.diff(begin)
        per = np.where(n > 0, np.maximum(1, n // WINDOW), 0)
        total = int(per.sum())
        if not total:
            return np.zeros(0), per
        s = np.concatenate([[0.0], np.cumsum(self.surprise(ids, begin, known))])
        doc = np.repeat(np.arange(len(n)), per)
        k = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
        lo, hi = begin[doc] + k * n[doc] // per[doc], begin[doc] + (k + 1) * n[doc] // per[doc]
        return (s[hi] - s[lo]) / (hi - lo), per


def _read(pdfs: Iterator[pd.DataFrame]):
    cache = _Classes()
    for pdf in lex.batches(pdfs, ROWS):
        ids, begin = sequences(cache, pdf["text"].tolist())
        prose, han = reads_as_prose(ids, begin)
        small = ids.astype(np.uint16)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "ids": [small[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], "is_prose": prose, "is_han": han})


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(pdf["ids"]), np.uint16).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(x) // 2 for x in pdf["ids"]])]).astype(np.int64)


def _counts(pdfs):
    sums = [np.zeros(size, np.int64) for size in (N, N * N, BUCKETS, BUCKETS)]
    for pdf in lex.batches(pdfs, ROWS):
        ids, begin = _joined(pdf)
        a, b = _before(ids, begin)
        for x, at in zip(sums, (ids, b * N + ids, *_keys(a, b, ids))):
            place, n = np.unique(at, return_counts=True)
            x[place] += n
    for k, x in enumerate(sums):
        at = np.flatnonzero(x)
        yield pd.DataFrame({"t": np.full(len(at), k, np.int32), "place": at, "n": x[at]})


def read_pages(docs: DataFrame) -> DataFrame:
    """``doc_id``, class sequence, and whether it reads as prose and is of ideographs, of every row of ``(doc_id, text)``."""
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    return rows.mapInPandas(_read, "doc_id bigint, ids binary, is_prose boolean, is_han boolean")


def counted(pages: DataFrame) -> Model:
    """The model of all pages that read as prose; the driver gets its counts, at most one number a bucket."""
    c = pages.where("is_prose").select("ids").mapInPandas(_counts, "t int, place bigint, n bigint").groupBy("t", "place").agg(F.sum("n").alias("n")).toPandas()
    return Model(c["t"].to_numpy(), c["place"].to_numpy(dtype=np.int64), c["n"].to_numpy(dtype=float))


def usual_range(pages: DataFrame, model: Model) -> dict[bool, tuple[float, float]]:
    """By whether a page is of ideographs, the log-perplexities between which all but ``2 * TAIL`` of the windows of prose lie.

    Windows are counted in bins of ``BIN``, so that what is shuffled doesn't grow with the
    corpus. Without prose of a kind the other kind's range serves, without any all is usual.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # arrays of fixed size

    def run(pdfs):
        sums = np.zeros((2, BINS), np.int64)
        for pdf in lex.batches(pdfs, ROWS):
            ids, begin = _joined(pdf)
            w, per = shared.value.windows(ids, begin, np.ones(len(pdf), bool))
            np.add.at(sums, (np.repeat(pdf["is_han"].to_numpy().astype(int), per), np.minimum((w / BIN).astype(int), BINS - 1)), 1)
        kind, at = np.nonzero(sums)
        yield pd.DataFrame({"is_han": kind.astype(bool), "bin": at, "n": sums[kind, at]})

    rows = pages.where("is_prose").select("ids", "is_han").mapInPandas(run, "is_han boolean, bin bigint, n bigint").groupBy("is_han", "bin").agg(F.sum("n").alias("n")).toPandas()
    out: dict[bool, tuple[float, float]] = {}
    for kind in (False, True):
        part = rows[rows["is_han"] == kind].sort_values("bin")
        if len(part):
            up = part["n"].cumsum().to_numpy() / part["n"].sum()
            b = part["bin"].to_numpy()
            out[kind] = float(b[np.searchsorted(up, TAIL)]) * BIN, float(b[min(np.searchsorted(up, 1 - TAIL), len(b) - 1)] + 1) * BIN
    for kind in (False, True):
        out.setdefault(kind, out.get(not kind, (0.0, float("inf"))))
    return out


def scored(pages: DataFrame, model: Model, usual: dict[bool, tuple[float, float]]) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(pdfs):
        low, high = (np.array([usual[k][i] for k in (False, True)]) for i in (0, 1))
        for pdf in lex.batches(pdfs, ROWS):
            ids, begin = _joined(pdf)
            w, per = shared.value.windows(ids, begin, pdf["is_prose"].to_numpy())
            doc = np.repeat(np.arange(len(pdf)), per)
            kind = pdf["is_han"].to_numpy().astype(int)[doc]
            n = np.maximum(per, 1)
            share = np.bincount(doc, (w < low[kind]) | (w > high[kind]), minlength=len(pdf)) / n
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "log_perplexity": np.bincount(doc, w, minlength=len(pdf)) / n, "abnormal_share": share, "is_stuffed": share > MIN_SHARE})

    return pages.mapInPandas(run, "doc_id bigint, log_perplexity double, abnormal_share double, is_stuffed boolean")


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, log_perplexity, abnormal_share, is_stuffed`` of every row of ``(doc_id, text)``.

    ``log_perplexity`` is the mean over the windows. Null and empty texts have no windows,
    a share of 0 and aren't flagged; repeated rows and ids stay separate rows. A corpus
    without prose flags nothing. Texts are read once, their classes written to the
    checkpoint folder; model and range come from all rows.
    """
    pages = checkpointed(read_pages(docs))
    model = counted(pages)
    return scored(pages, model, usual_range(pages, model))
