"""Main body of a page (problem 4).

A page is a sequence of lines. Words speak for the body and tags against it: separators,
runs of short lines, headings of link lists and what follows them, site names, copyright
marks, and words that menus, notices and footers are made of. The weights of both are fitted
by logistic regression on a small table of labelled pages, and every line is scored, however
long. A linear scan then finds the content region of the maximal score. As pages have
furniture between their paragraphs, too, a region may be broken up, at a price: of all ways
to choose regions, the one with the greatest sum of scores, less ``PRICE`` for each region,
is the main body. A line is furniture because it lies outside of all regions, not by its own
score: a weak line between paragraphs stays, a good one between menus goes.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import labelled_pages, lex
from gristmill.sources.tables import spread

#: What it costs to begin a region; the most that a single line may count.
PRICE, MOST = 1.0, 8.0

_SEP = re.compile(r"\s*[|»·•›]\s*|\s+[/>-]\s+|\s{2,}|\t")
_BULLET = re.compile(r"^\s*(?:[-–—>•*‣▸►]|\d+[.)])\s+")
_END = re.compile(r"[.!?…。！？;:,][\"'”»)\]]*\s*$")
_SEPARATED = re.compile(r"[|»·•›\t]| [/>-] |  ")
_COPY = re.compile(r"\(c\)\s*\d{4}", re.I)
_OWNER = re.compile(r"(?:©|\(c\)|copyright)[\s\d,–-]*([A-Z][\w-]+(?: [A-Z][\w-]+)?)", re.I)
_STOP = re.compile(r"[.!?]\s|[。！？；，]")
_DIGITS = re.compile(r"\d+")
_COUNT = re.compile(r"\(\d+\)")
_YEAR = re.compile(r"\s(?:19|20)\d\d$")
_CODE = re.compile(r"[{}\[\]<>=_\\^]|\w[.;:]\w")
_TAGS = (
    "bias", "words", "new", "end", "stop", "common", "one", "title", "parts", "two", "menu_parts", "copy", "digits", "bullet", "upper", "lower", "code", "dated",
    "site", "names_site", "head", "listed", "above", "run", "menu_run", "parts_page",
)


_TAG_SET = frozenset(_TAGS)


def parts_of(line: str) -> list[str]:
    return [p for p in _SEP.split(line.strip()) if p and p.strip()]


def _stem(w: str) -> str:
    return w[:5]


_HEADS = frozenset(_stem(w) for row in labelled_pages.LIST_HEADINGS for w in lex.words_han(row.replace("{s}", " ")))
_PLAIN = frozenset(map(_stem, lex.COMMON))
#: Stems of the words of menus, notices and headings; other words are new.
_FURNITURE = _HEADS | {_stem(w) for row in (*labelled_pages.MENU, *labelled_pages.NOTICE) for w in lex.words_han(re.sub(r"\{\w\}", " ", row))}


_MENU = frozenset(p.lower() for row in labelled_pages.MENU for p in row.split("|"))


def _new(ws: list[str]) -> float:
    """Share of the words, numbers aside, that menus and notices don't hold; a half without words."""
    own = [w for w in ws if not w.isdigit()]
    return sum(_stem(w) not in _FURNITURE for w in own) / len(own) if own else 0.5


def is_heading(ws: list[str], text: str) -> bool:
    """Whether a short line is made of the words of headings of link lists, at least one of them no mere function word."""
    if not 1 <= len(ws) <= 8 or text.lower() in _MENU or _END.search(text.rstrip(":： ")) or any(c.isdigit() for c in text):
        return False
    hits = [w for w in map(_stem, ws) if w in _HEADS]
    if len(ws[0]) == 1 and len(ws) > 1 and not ws[0].isascii():
        return len(hits) == len(ws)
    return len(hits) * 3 >= 2 * len(ws) and (any(h not in _PLAIN for h in hits) or len(hits) == len(ws) > 2)


def line_features(line: str) -> tuple[dict[str, float], list[str], int]:
    """Tags that depend on the line alone; the stems of the words, and the pairs of words, that furniture is made of; how many words the line has."""
    text = line.strip()
    low = text.lower()
    ws = lex.WORD_HAN.findall(low)
    n = len(ws)
    stems = [w[:5] for w in ws]
    at = [i for i, s in enumerate(stems) if s in _FURNITURE]
    numbers = _DIGITS.search(text) is not None
    own = n - (sum(map(str.isdigit, ws)) if numbers else 0)
    known = len(at) - (sum([ws[i].isdigit() for i in at]) if numbers else 0)
    t: dict[str, float] = {"bias": 1.0, "words": min(n, 12) / 12, "new": 1 - known / own if own else 0.5}
    ended = _END.search(text[-12:]) is not None
    if ended:
        t["end"] = 1.0
    if _STOP.search(text):
        t["stop"] = 1.0
    if n >= 4:
        t["common"] = sum(map(lex.COMMON.__contains__, ws)) / n
    digits = 0
    if numbers:
        bare = _COUNT.sub("", text)
        digits = sum(map(str.isdigit, bare))
    if digits * 6 > len(text):
        t["digits"] = 1.0
    upper = n > 1 and text.isupper()
    if upper:
        t["upper"] = 1.0
    if _CODE.search(text):
        t["code"] = 1.0
    if n == 1 and not ended:
        t["one"] = 1.0
    elif n <= 10 and not ended:
        t["title"] = 1.0
    if text[:1].islower():
        t["lower"] = 1.0
    if n <= 4 and digits and _YEAR.search(text):
        t["dated"] = 1.0
    if _BULLET.match(line):
        t["bullet"] = 1.0
    if not digits and not upper and _SEPARATED.search(text):
        parts = parts_of(text)
        if len(parts) > 1 and sum(map(len, parts)) <= 26 * len(parts):
            t["parts" if len(parts) > 2 else "two"] = 1.0
            menu = sum([_new(lex.words_han(p)) < 0.5 for p in parts])
            if menu:
                t["menu_parts"] = min(1.0, 0.4 + menu / len(parts))
    if "©" in low or "copyright" in low or "(c)" in low and _COPY.search(text) or "版权所有" in low:
        t["copy"] = 1.0
    if n <= 8 and is_heading(ws, text):
        t["head"] = 1.0
    return t, [stems[i] for i in at] + [f"{ws[i]} {ws[j]}" for i, j in zip(at, at[1:]) if j == i + 1], n


@lru_cache(maxsize=50_000)
def line_tags(line: str) -> tuple[dict[str, float], float, int]:
    """Tags of the line alone, the weight of its words, and how many words it has."""
    t, ws, n = line_features(line)
    get = weights().get
    return t, sum([get(w, 0.0) for w in ws if w not in _TAG_SET]) / max(1, n) ** 0.5, n


def site_key(url: str | None) -> str:
    """Letters of the host of an address, without www. and top-level domain."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#:]+)", (url or "").strip().lower())
    if not m:
        return ""
    return re.sub(r"[^a-z0-9]", "", re.sub(r"^www\.", "", m[1]).rsplit(".", 1)[0])


def _squeezed(s: str) -> str:
    return re.sub(r"[\s\d.'’©-]", "", s.lower())


def _page(lines: list[str], url: str | None, of_line) -> list:
    """``(tags, words)`` of every line, those that depend on its neighbours put in; None for a blank line."""
    out: list = [None if not line or line.isspace() else of_line(line) for line in lines]
    out = [x and (dict(x[0]), *x[1:]) for x in out]
    solid = [i for i, x in enumerate(out) if x is not None]
    site = site_key(url)
    if not site:
        owner = next((m for i in solid if "copy" in out[i][0] and (m := _OWNER.search(lines[i]))), None)
        site = _squeezed(owner[1]) if owner else ""
    separated = sum("parts" in out[i][0] or "two" in out[i][0] for i in solid)
    if sum("dated" in out[i][0] for i in solid) > 2:  # a list of dated things
        for i in solid:
            out[i][0].pop("dated", None)
    listing = None
    for i in solid:
        t, _, n = out[i]
        line = lines[i]
        if separated > 3 and separated * 2 > len(solid) and ("parts" in t or "two" in t):
            t["parts_page"] = 1.0
        if len(site) > 3 and n < 25:
            low = _squeezed(line)
            if low == site:
                t["site"] = 1.0
            elif site in low and "@" not in line and "://" not in line and "www." not in line:
                t["names_site"] = 1.0
        if listing is not None and i - listing > 1:
            listing = None  # a blank line ends a list
        if "head" in t and n <= 8:
            listing = i
        elif listing is not None:
            if n <= 20 and len(line) < 90 and "stop" not in t and not line.rstrip().endswith((".", "!", "。", "！")):
                t["listed"] = 1.0
                listing = i
            else:
                listing = None
    for i, j in zip(solid, solid[1:]):
        if "title" in out[i][0] and "listed" not in out[i][0] and out[j][2] >= 12 and "end" in out[j][0]:
            out[i][0]["above"] = 1.0
    # runs of short lines without a gap; those with entries of known menus are one
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] is not None and out[j][2] <= 4 and "end" not in out[j][0] and "digits" not in out[j][0] and "code" not in out[j][0] and "bullet" not in out[j][0] and "listed" not in out[j][0]:
            j += 1
        if j - i >= 3:
            known = sum(out[k][0]["new"] < 0.5 for k in range(i, j))
            for k in range(i, j):
                out[k][0]["run"] = 1.0
                if known:
                    out[k][0]["menu_run"] = min(1.0, 0.5 + known / (j - i))
        i = max(j, i + 1)
    return out


def page_tags(lines: list[str], url: str | None = None) -> list[tuple[dict[str, float], float] | None]:
    """Tags of every line and the weight of its words; None for a blank line."""
    return [x and x[:2] for x in _page(lines, url, line_tags)]


@lru_cache(maxsize=1)
def fitted_weights() -> dict[str, float]:
    """Weight of every tag and word, positive for the body; fitted on the labelled pages.

    Words are fitted first, on single lines, as the tags of runs go by them; then all
    together with the tags of the neighbours.
    """
    made = labelled_pages.pages()
    known = {line: line_features(line) for _, lines in made for line, _ in lines if line}
    bad: dict[str, int] = {}
    for line in {line for _, lines in made for line, good in lines if not good}:
        for w in set(known[line][1]):
            bad[w] = bad.get(w, 0) + 1
    vocab = {k: i for i, k in enumerate(_TAGS)}
    for w in sorted(bad):
        if w not in vocab and not w.isdigit() and (" " not in w or bad[w] > 1):
            vocab[w] = len(vocab)

    def words_of(line: str) -> list[tuple[int, float]]:
        _, ws, n = known[line]
        return [(vocab[w], 1 / max(1, n) ** 0.5) for w in ws if w in vocab and w not in _TAG_SET]

    def solve(rows: list[tuple[list[tuple[int, float]], float]]) -> np.ndarray:
        """Ridge logistic regression by accelerated gradient steps over the sparse rows."""
        size = np.array([len(r) for r, _ in rows])
        col = np.array([c for r, _ in rows for c, _ in r])
        val = np.array([v for r, _ in rows for _, v in r])
        row = np.repeat(np.arange(len(rows)), size)
        y = np.array([g for _, g in rows])
        w, z = np.zeros(len(vocab)), np.zeros(len(vocab))
        decay = np.where(np.arange(len(vocab)) < len(_TAGS), 1e-5, 2e-5)
        for k in range(700):
            p = 1 / (1 + np.exp(-np.bincount(row, val * z[col], minlength=len(rows))))
            new = z - 0.8 * (np.bincount(col, val * (p - y)[row], minlength=len(vocab)) / len(rows) + decay * z)
            z = new + k / (k + 3) * (new - w)
            w = new
        return w

    def tags(t: dict[str, float]) -> list[tuple[int, float]]:
        return [(vocab[k], v) for k, v in t.items()]

    single = {(line, good) for _, lines in made for line, good in lines if line}
    first = solve([(tags(known[line][0]) + words_of(line), float(good)) for line, good in sorted(single)])
    inside = {line: sum(first[c] * v for c, v in words_of(line)) for line in known}
    rows = []
    for url, lines in made:
        texts = [line for line, _ in lines]
        of_line = lambda line: (known[line][0], inside[line], known[line][2])
        for (line, good), x in zip(lines, _page(texts, url, of_line)):
            if x is not None:
                rows.append((tags(x[0]) + words_of(line), float(good)))
    w = solve(rows)
    return {k: float(w[i]) for k, i in vocab.items()}


def score(t: dict[str, float], words: float, wt: dict[str, float]) -> float:
    return sum([wt[k] * v for k, v in t.items()]) + words


def best_regions(scores: list[float], price: float = PRICE) -> list[tuple[int, int]]:
    """Disjoint runs ``(begin, end)`` with the greatest sum of scores, less ``price`` for each, in one scan; none if no run is worth its price.

    Of equal choices the one with the shorter runs. With a price beyond all sums of scores
    that break up a run this is the single maximum-scoring run.
    """
    off, on = 0.0, float("-inf")
    entered: list[bool] = []  # whether the best choice that is in a region at i begins it there
    left: list[bool] = []  # whether the best choice that is in none at i leaves one there
    for s in scores:
        begin = off - price > on
        left.append(on > off)
        off, on = max(off, on), max(on, off - price) + s
        entered.append(begin)
    runs, end = [], len(scores)
    inside = on > off
    for i in range(len(scores) - 1, -1, -1):
        if inside:
            if entered[i]:
                runs.append((i, end))
                inside = False
        elif left[i]:
            inside, end = True, i
    return runs[::-1]


def furniture_lines(text: str | None, url: str | None = None) -> list[int]:
    """Numbers from 1 of the lines of ``text`` that are not main body; blank lines are never among them."""
    if not text:
        return []
    tagged = page_tags(text.split("\n"), url)
    wt = weights()
    scores = [0.0 if x is None else max(-MOST, min(MOST, score(*x, wt))) for x in tagged]
    keep = np.zeros(len(scores), bool)
    for b, e in best_regions(scores):
        keep[b:e] = True
    return [i + 1 for i, x in enumerate(tagged) if x is not None and not keep[i]]


_shipped: dict[str, float] | None = None


def weights() -> dict[str, float]:
    """The fitted weights, or those shipped with a task."""
    return _shipped if _shipped is not None else fitted_weights()


def use(wt: dict[str, float]) -> None:
    """Takes weights that the driver fitted, so that no worker fits them again."""
    global _shipped
    _shipped = wt


def shipped(run):
    """``run`` over the frames of a partition, under the weights of the driver."""
    wt = fitted_weights()

    def with_weights(pdfs):
        use(wt)
        yield from run(pdfs)

    return with_weights


def _numbers(pdfs):
    for pdf in pdfs:
        found = [furniture_lines(t, u) for t, u in zip(pdf["text"], pdf["url"])]
        at = np.repeat(np.arange(len(pdf)), [len(f) for f in found])
        yield pd.DataFrame({"rec_id": pdf["rec_id"].to_numpy()[at], "line_no": np.array([n for f in found for n in f], dtype=np.int32)})


def _texts(pdfs):
    for pdf in pdfs:
        out = []
        for t, u in zip(pdf["text"], pdf["url"]):
            bad = set(furniture_lines(t, u))
            out.append(t if not t or not bad else "\n".join(line for i, line in enumerate(t.split("\n"), 1) if i not in bad).strip("\n"))
        yield pd.DataFrame({"rec_id": pdf["rec_id"].to_numpy(), "text": pd.Series(out, dtype=object)})


def _rows(df: DataFrame) -> DataFrame:
    return spread(df.select("rec_id", "text", "url"), "rec_id")


def furniture(df: DataFrame) -> DataFrame:
    """``rec_id, line_no`` of every furniture line of ``(rec_id, text, url)``; null and empty texts have none, a null url only hides the site name."""
    return _rows(df.where("text IS NOT NULL")).mapInPandas(shipped(_numbers), "rec_id bigint, line_no int")


def main_text(df: DataFrame) -> DataFrame:
    """``rec_id, text`` with only the lines of the main body, one row per row; null stays null and empty stays empty."""
    return _rows(df).mapInPandas(shipped(_texts), "rec_id bigint, text string")
