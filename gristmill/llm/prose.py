"""Text quality statistics and natural prose (problem 2).

Texts are cut into chunks of ``CHUNK`` characters wherever that falls. Each chunk gives
partial counts: of its whole lines, and of the unfinished lines at its two ends, whose
state (counts, the word fragments at the edges, the text while it is short) lets the
neighbour complete the word and the line. Two partial counts merge into one, associatively,
so chunks are merged up a tree of fan-in ``FAN``; ratios and the verdict come from the root.
A text of one chunk never leaves its row.
"""
from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import lex, main_body
from gristmill.sources.tables import spread

CHUNK = 16_384
FAN = 512
#: Lines up to this length are kept as text where a chunk cuts them, so that they can be scored as a whole; longer
#: ones, wherever they are cut, count as body. A word longer than LONG_WORD is never a common word.
SHORT, LONG_WORD = 4_000, 40
#: Body texts with a lower share of common words (of sentence marks among ideographs) are not prose.
MIN_COMMON, MIN_HAN_MARKS = 0.18, 0.03
#: A body without any word counts as junk from this many characters on.
MIN_JUNK = 20

#: Languages whose function words aren't known: least share of words of up to three letters, words to a sentence end, most symbols, mean length of a word.
MIN_SHORT, SENTENCE, MAX_SYMBOLS, MAX_LENGTH = 0.15, (4, 60), 0.10, 9.0

NAMES = ("lines", "end_lines", "words", "word_chars", "common", "symbols", "chars", "han", "han_marks", "short", "stops")
_HAN = re.compile(f"[{lex.HAN}]")
_MARKS = re.compile("[。，！？；]")
_TOKEN = re.compile(f"[{lex.HAN}]|[^\\W_{lex.HAN}]+")
_ENDS = tuple(".!?…。！？;:\"'”»’")
# state: (whole lines: all, body; head piece; tail piece or None if there was no line break)
# piece: (n_chars, text if short else None, counts of finished words, first fragment, last fragment, last visible char)


def _is_word(c: str) -> bool:
    return c.isalnum()


def _counts() -> list[int]:
    return [0] * len(NAMES)


def _add(a, b):
    return [x + y for x, y in zip(a, b)]


def _word(counts: list[int], length: int, word: str | None) -> None:
    counts[2] += 1
    counts[3] += length
    if word is not None and 2 <= length and word in lex.COMMON:
        counts[4] += 1
    if length <= 3 and word is not None and word.isalpha():
        counts[9] += 1


class _Kinds(dict):
    """word -> 1 for a common word, plus 2 for up to three letters; 4 for an ideograph."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        kind = 4 if _HAN.match(word) else (len(word) > 1 and word in lex.COMMON) + 2 * (len(word) <= 3 and word.isalpha())
        self[word] = kind
        return kind


_kinds = _Kinds()


def _count_text(text: str, counts: list[int]) -> None:
    """Adds words, symbols and marks of ``text`` to ``counts``."""
    tokens = _TOKEN.findall(text.lower())
    kinds = bytes(map(_kinds.__getitem__, tokens))
    n = len("".join(tokens))
    both = kinds.count(3)
    chars = len("".join(text.split()))
    counts[2] += len(tokens)
    counts[3] += n
    counts[4] += kinds.count(1) + both
    counts[6] += chars
    counts[5] += max(0, chars - n)
    counts[7] += kinds.count(4)
    counts[9] += kinds.count(2) + both
    counts[10] += text.count(".") + text.count("!") + text.count("?") + text.count("…")
    if not text.isascii():
        counts[8] += len(_MARKS.findall(text))


def _fragment(s: str) -> tuple[int, str | None]:
    return len(s), (s.lower() if len(s) <= LONG_WORD else None)


def piece(text: str):
    """An unfinished line. Words that touch an edge stay fragments until the neighbour is known."""
    i, n = 0, len(text)
    while i < n and _is_word(text[i]) and not _HAN.match(text[i]):
        i += 1
    counts = _counts()
    if i == n:
        first = last = None
        whole = _fragment(text)
    else:
        j = n
        while j > i and _is_word(text[j - 1]) and not _HAN.match(text[j - 1]):
            j -= 1
        _count_text(text[i:j], counts)
        first, last, whole = _fragment(text[:i]), _fragment(text[j:]), None
    stripped = text.rstrip()
    return [n, text if n <= SHORT else None, counts, first, last, whole, stripped[-1:]]


def _join(a: tuple[int, str | None], b: tuple[int, str | None]) -> tuple[int, str | None]:
    n = a[0] + b[0]
    return n, (a[1] + b[1] if a[1] is not None and b[1] is not None and n <= LONG_WORD else None)


def join_pieces(a, b):
    """The piece of two neighbouring pieces of one line."""
    n = a[0] + b[0]
    text = a[1] + b[1] if a[1] is not None and b[1] is not None and n <= SHORT else None
    counts = _add(a[2], b[2])
    if a[5] is not None and b[5] is not None:
        first = last = None
        whole = _join(a[5], b[5])
    elif a[5] is not None:
        first, last, whole = _join(a[5], b[3]), b[4], None
    elif b[5] is not None:
        first, last, whole = a[3], _join(a[4], b[5]), None
    else:
        middle = _join(a[4], b[3])
        if middle[0]:
            _word(counts, *middle)
            counts[6] += middle[0]
        first, last, whole = a[3], b[4], None
    return [n, text, counts, first, last, whole, b[6] or a[6]]


def close(p, state) -> None:
    """Adds the finished line ``p`` to the totals of ``state``."""
    counts = list(p[2])
    for part in ([p[5]] if p[5] is not None else [p[3], p[4]]):
        if part[0]:
            _word(counts, *part)
            counts[6] += part[0]
    if not counts[6]:
        return
    counts[0] = 1
    counts[1] = int(p[6] in _ENDS)
    state[0] = _add(state[0], counts)
    if p[1] is None or not is_furniture(p[1]):
        state[1] = _add(state[1], counts)


def is_furniture(line: str) -> bool:
    """Whether the line by itself scores against the main body; of two lines of the same look one can't tell a menu from a list."""
    if len(line) > SHORT:
        return False
    tags, words, _ = main_body.line_tags(line)
    return main_body.score(tags, words, main_body.weights()) < 0


def chunk_state(text: str):
    """The partial counts of one chunk."""
    lines = text.split("\n")
    if len(lines) == 1:
        return [_counts(), _counts(), piece(text), None]
    every, body = _counts(), _counts()
    left_out, kept = [], []
    for line in lines[1:-1]:
        if not line or line.isspace():
            continue
        into = left_out if is_furniture(line) else kept
        into.append(line)
        ended = line.rstrip()[-1:] in _ENDS
        every[0] += 1
        every[1] += ended
        if into is kept:
            body[0] += 1
            body[1] += ended
    _count_text("\n".join(kept), body)
    other = _counts()
    _count_text("\n".join(left_out), other)
    every = every[:2] + _add(body[2:], other[2:])
    return [every, body, piece(lines[0]), piece(lines[-1])]


def merge(a, b):
    """Partial counts of two neighbouring stretches of a text; associative."""
    state = [_add(a[0], b[0]), _add(a[1], b[1]), a[2], a[3]]
    if a[3] is None and b[3] is None:
        state[2] = join_pieces(a[2], b[2])
        return state
    if a[3] is None:
        state[2], state[3] = join_pieces(a[2], b[2]), b[3]
        return state
    middle = join_pieces(a[3], b[2])
    if b[3] is None:
        state[3] = middle
        return state
    close(middle, state)
    state[3] = b[3]
    return state


def finish(state) -> tuple[list[int], list[int]]:
    """Counts of all lines and of the body's, once both ends of the text are known."""
    end = [state[0], state[1], None, None]
    for p in (state[2], state[3]):
        if p is not None:
            close(p, end)
    return end[0], end[1]


def verdict(body: list[int]) -> str:
    """``prose``, ``list`` (no sentences) or ``junk`` (no words); ``empty`` without body.

    Text of ideographs needs marks between them, other text function words. Where these are
    few, the text may be in another language: it is prose if it has short words, sentences
    of a usual length, few symbols and words of a usual length.
    """
    d = dict(zip(NAMES, body))
    words, chars = d["words"], d["chars"]
    if not words:
        return "junk" if chars >= MIN_JUNK else "empty"
    if d["han"] * 2 >= words:
        return "prose" if d["han_marks"] >= MIN_HAN_MARKS * d["han"] else "list"
    if d["common"] >= MIN_COMMON * words:
        return "prose"
    low, high = SENTENCE
    other = (
        d["short"] >= MIN_SHORT * words and low * d["stops"] <= words <= high * d["stops"] and d["symbols"] <= MAX_SYMBOLS * chars
        and d["word_chars"] <= MAX_LENGTH * words and d["end_lines"] * 4 >= d["lines"]
    )
    return "prose" if other else "list"


def statistics(text: str | None, chunk: int = CHUNK):
    """Counts of all lines and of the body's lines of one text."""
    text = text or ""
    state = chunk_state(text[:chunk])
    for i in range(chunk, len(text), chunk):
        state = merge(state, chunk_state(text[i : i + chunk]))
    return finish(state)


_OUT = "rec_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, end_punctuation double, common_ratio double, verdict string"


def _row(rec_id, counts) -> tuple:
    every, body = counts
    d = dict(zip(NAMES, every))
    return (
        rec_id, d["words"], d["word_chars"] / d["words"] if d["words"] else 0.0, d["symbols"] / d["chars"] if d["chars"] else 0.0,
        d["end_lines"] / d["lines"] if d["lines"] else 0.0, d["common"] / d["words"] if d["words"] else 0.0, verdict(body),
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])


def _single(pdfs):
    for pdf in pdfs:
        yield _frame([_row(i, statistics(t)) for i, t in zip(pdf["rec_id"], pdf["text"])])


def _chunks(pdfs):
    for pdf in pdfs:
        yield pd.DataFrame({"row": pdf["row"], "rec_id": pdf["rec_id"], "at": pdf["at"], "n": np.ones(len(pdf), np.int32), "state": [pickle.dumps(chunk_state(t)) for t in pdf["chunk"]]})


def _merge_group(pdf: pd.DataFrame, wt: dict[str, float]) -> pd.DataFrame:
    """One state of neighbouring ones. Rows of the same id and text have the same states: each counts once, and ``n`` says how many rows there were."""
    main_body.use(wt)
    pdf = pdf.sort_values("at", kind="stable")
    at = pdf["at"].to_numpy()
    n = int(pdf["n"].iloc[0]) * int((at == at[0]).sum())
    states = [pickle.loads(s) for s in pdf["state"][np.append(True, at[1:] != at[:-1])]]
    state = states[0]
    for other in states[1:]:
        state = merge(state, other)
    return pd.DataFrame({"row": pdf["row"][:1], "rec_id": pdf["rec_id"][:1], "at": pdf["at"][:1] // FAN, "n": np.array([n], np.int32), "state": [pickle.dumps(state)]})


def _root(pdfs):
    for pdf in pdfs:
        yield _frame([_row(i, finish(pickle.loads(s))) for i, n, s in zip(pdf["rec_id"], pdf["n"], pdf["state"]) for _ in range(n)])


def text_statistics(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``rec_id, n_words, mean_word_length, symbol_ratio, end_punctuation, common_ratio, verdict``, one row per row.

    Ratios of nothing are 0; null and empty texts get the verdict ``empty``. symbol_ratio
    is the share of visible characters that are neither letters nor digits; words are runs
    of letters and digits, ideographs single. Rows that share an id keep one row each.
    """
    rows = spread(df.select(F.col(id_col).alias("rec_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "rec_id")
    short = rows.where(F.length("text") <= chunk).mapInPandas(main_body.shipped(_single), _OUT)
    state = "row binary, rec_id bigint, at bigint, n int, state binary"
    # chunks go by the hash of their text and the id; no whole text is moved
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    parts = rows.where(F.length("text") > chunk).select(F.unhex(F.sha2("text", 256)).alias("row"), "rec_id", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))).alias("at", "chunk"))
    states = parts.select("row", "rec_id", F.col("at").cast("bigint").alias("at"), "chunk").mapInPandas(main_body.shipped(_chunks), state)
    wt = main_body.fitted_weights()
    for _ in range(2):  # FAN * FAN chunks are more than one string can have
        states = states.groupBy("row", "rec_id", F.floor(F.col("at") / FAN).alias("up")).applyInPandas(lambda pdf: _merge_group(pdf, wt), state)
    return short.unionByName(states.mapInPandas(main_body.shipped(_root), _OUT))
