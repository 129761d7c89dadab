"""Abusive, hateful and sexually explicit language (problem 5).

A factorization machine over hashed terms: a window of words scores
``w0 + sum w_i + sum <v_i, v_j>``, so that pairs of words (an insult and "you", a slur and
the name of a group) count beyond what the single words say. It is fitted on the labelled
sample of the corpus (at most ``MAX_LABELLED`` rows) and on a small table of this library.
A text scores as its worst window of ``WINDOW`` words; an address by the words of its path.
Spelling is undone first: compatibility forms, letters written apart, digits and signs for
letters, and single masked letters where that gives a word known from abusive rows.
"""
from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import labelled_abuse, labelled_pages, lex
from gristmill.sources.tables import spread

WINDOW = 12
#: A window may also begin later, as long as it holds this many words.
SHORTEST = 6
DIMS = 1 << 18
RANK = 6
#: Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 5_000
#: Bound of the texts that a loose score calls harmless, used as background.
MAX_BACKGROUND = 500
THRESHOLD = 0.7

_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){2,}[^\W\d_](?![^\W_])")
_SIGN = re.compile(r"[@$*.!|#€0-9+](?=[^\W\d_])|(?<=[^\W\d_])\*")
_BREAK = frozenset(" \t\n\r,;:?\"()<>[]")
_MASK = re.compile(r"[@$*.!|#€0-9+_-]")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_SHORTEN = re.compile(r"(.)\1{2,}")
_CYRILLIC = re.compile("[а-я]")
_MIXED = str.maketrans("асеорхуіѕ", "aceopxyis")


class _Rows(dict):
    """word -> row of its hashed term in the model, 0 if it has none."""

    def __init__(self, rows: dict[int, int]):
        self.terms = rows

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        r = self[word] = self.terms.get(term(word), 0)
        return r


class Model:
    """Weights of the terms seen in training; other terms weigh nothing."""

    def __init__(self, rows: dict[int, int], w: np.ndarray, v: np.ndarray, w0: float, masked: dict[int, list[str]]):
        self.rows, self.w, self.v, self.w0, self.masked = rows, w, v, w0, masked
        self.cache = _Rows(rows)
        self.unmasked: dict[str, str] = {}

    def unmask(self, token: str) -> str:
        """The known abusive word that a token with signs or digits for letters stands for, or the token."""
        if len(token) > 40:
            return token
        got = self.unmasked.get(token)
        if got is None:
            if len(self.unmasked) > 200_000:
                self.unmasked.clear()
            got = self.unmasked[token] = self._unmask(token)
        return got

    def _unmask(self, token: str) -> str:
        t = token.rstrip(".!")
        for t in (t, t.strip("@#.!")):
            leet = t.translate(_LEET)
            for w in self.masked.get(len(t), ()):
                same = sum(a == b for a, b in zip(t, w))
                if leet == w or same * 2 >= len(w) - 1 and all(a == b or _MASK.match(a) for a, b in zip(t, w)):
                    return w
            bare = _MASK.sub("", leet)
            if bare in self.masked.get(len(bare), ()):
                return bare
        return token

    def tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u00ad", "")
            if _CYRILLIC.search(text):
                text = text.translate(_MIXED)
        text = text.lower()
        if _APART.search(text):
            text = _APART.sub(self._together, text)
        text = self._unmask_all(text)
        text = _SHORTEN.sub(r"\1\1", text)
        return lex.WORD_HAN.findall(text)

    def _unmask_all(self, text: str) -> str:
        """``text`` with masked words undone around every sign or digit that a letter follows."""
        out, done = [], 0
        for m in _SIGN.finditer(text):
            i = m.start()
            if i < done:
                continue
            b = i
            while b > done and i - b < 40 and text[b - 1] not in _BREAK:
                b -= 1
            e = i + 1
            while e < len(text) and e - i < 40 and text[e] not in _BREAK:
                e += 1
            token = text[b:e]
            word = self.unmask(token)
            if word is not token:
                out += [text[done:b], word]
            else:
                out.append(text[done:e])
            done = e
        return "".join(out) + text[done:] if out else text

    def _together(self, m: re.Match) -> str:
        word = re.sub(r"[^\w]|_", "", m[0])
        for w in self.masked.get(len(word), ()):
            if w == word:
                return w
        # the run may swallow a neighbouring one-letter word
        for cut in (word[1:], word[:-1]):
            if cut in self.masked.get(len(cut), ()):
                return cut
        return m[0]

    def window_scores(self, docs: list[list[str]], width: int = WINDOW) -> np.ndarray:
        """The highest score of a window in each document; -inf for one without words."""
        lengths = np.array([len(d) for d in docs])
        cache = self.cache
        flat = np.array([cache[w] for d in docs for w in d], dtype=np.int32)
        best = np.full(len(docs), -np.inf)
        if not len(flat):
            return best
        starts = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(docs)), lengths)
        known = np.flatnonzero(flat)
        best[lengths > 0] = self.w0
        if not len(known):
            return best
        # Only windows that end at a term of the model can be the best one. Walk back over the
        # model's terms before it; a term counts once, however often a window holds it.
        terms = flat[known]
        at = doc[known]
        # where the same term comes next in its text
        key = at * len(self.w) + terms
        order = np.argsort(key, kind="stable")
        again = np.full(len(known), len(known))
        same = key[order][1:] == key[order][:-1]
        again[order[:-1][same]] = order[1:][same]
        total = self.w0 + self.w[terms]
        s1 = self.v[terms].copy()
        s2 = s1 * s1
        top = np.full(len(known), -np.inf)
        for k in range(1, width):
            live = np.flatnonzero((known[k:] - known[:-k] < width) & (at[k:] == at[:-k])) + k
            if not len(live):
                break
            # the window that ends before this term, if it is not too short to tell
            full = live[known[live] - known[live - k] >= SHORTEST]
            top[full] = np.maximum(top[full], total[full] + 0.5 * (s1[full] ** 2 - s2[full]).sum(axis=1))
            live = live[again[live - k] > live]
            r = terms[live - k]
            total[live] += self.w[r]
            vv = self.v[r]
            s1[live] += vv
            s2[live] += vv * vv
        score = np.maximum(top, total + 0.5 * (s1 * s1 - s2).sum(axis=1))
        np.maximum.at(best, at, score)
        return best

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that a text holds a window of abusive language; 0 without text."""
        s = self.window_scores([self.tokens(t) if t else [] for t in texts])
        return np.where(np.isneginf(s), 0.0, 1 / (1 + np.exp(-np.clip(s, -30, 30))))


def term(word: str) -> int:
    """The hashed term of a word."""
    import xxhash

    return xxhash.xxh32_intdigest(word) & (DIMS - 1)


def url_words(url: str | None) -> str:
    """Words of an address without its scheme, top-level domain and query, in groups between slashes."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", (url or "").strip().lower())
    if not m:
        return ""
    host = re.sub(r"^www\.", "", m[1]).rsplit(".", 1)[0]
    return re.sub(r"[-_.+]", " ", host) + m[2].replace("-", " ").replace("_", " ").replace(".", " ")


def _windows(ws: list[str]) -> list[list[str]]:
    if len(ws) <= WINDOW:
        return [sorted(set(ws))] if ws else []
    return [sorted(set(ws[i : i + WINDOW])) for i in range(0, len(ws) - WINDOW + 4, 4)]


def fit(labelled: list[tuple[str | None, bool | None]], background: list[str] = (), rounds: int = 3, steps: int = 170, seed: int = 7) -> Model:
    """Fits the machine; of an abusive row only its worst window counts, of another row all windows do.

    Rows of the sample whose fitted score contradicts their label strongly after the first
    round are taken for labelling errors and left out of the later ones. ``background``
    are texts that a weak scorer found harmless; their windows, one after the other, count as such.
    """
    blank = Model({}, np.zeros(1), np.zeros((1, RANK)), 0.0, {})
    own = [(line[1:], line[0] == "!") for line in labelled_abuse.ROWS.strip().split("\n")]
    calm = labelled_pages.harmless()
    own += [(line, False) for line in calm] + [(" ".join(calm[i : i + 4]), False) for i in range(0, len(calm), 5)]
    rows = [(blank.tokens(t), y, False) for t, y in labelled if t and y is not None] + [(blank.tokens(t), y, True) for t, y in own]
    bags = [(_windows(ws), y, mine) for ws, y, mine in rows if ws]
    for t in background:
        ws = blank.tokens(t)
        for i in range(0, len(ws), WINDOW):
            bags.append(([sorted(set(ws[i : i + WINDOW]))], False, None))
    vocab: dict[int, int] = {}
    counts: dict[str, list[int]] = {}
    for wins, y, mine in bags:
        for w in {w for win in wins for w in win}:
            vocab.setdefault(term(w), len(vocab) + 1)
            counts.setdefault(w, [0, 0])[y] += 1
    n = len(vocab) + 1
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(n), rng.normal(0, 0.02, (n, RANK)), -1.0
    v[0] = 0
    items, owner = [], []
    for b, (wins, _, _) in enumerate(bags):
        for win in wins:
            items.append([vocab[term(x)] for x in win][:WINDOW])
            owner.append(b)
    idx = np.zeros((len(items), WINDOW), dtype=np.int64)
    for i, item in enumerate(items):
        idx[i, : len(item)] = item
    owner = np.array(owner)
    label = np.array([y for _, y, _ in bags], dtype=float)
    trust = np.array([1.0 if mine is None else 4.0 if mine else 1.0 for _, _, mine in bags])
    keep = np.ones(len(bags), bool)
    m = [np.zeros_like(w), np.zeros_like(v)]
    g2 = [np.zeros_like(w), np.zeros_like(v)]
    t = 0

    def raw(sel):
        vv = v[idx[sel]]
        s1 = vv.sum(axis=1)
        return w0 + w[idx[sel]].sum(axis=1) + 0.5 * (s1 * s1 - (vv * vv).sum(axis=1)).sum(axis=1), vv, s1

    for r in range(rounds):
        every, _, _ = raw(np.arange(len(items)))
        # of an abusive row the worst window, once there is a model to tell
        worst = np.full(len(bags), -np.inf)
        np.maximum.at(worst, owner, every)
        sel = np.flatnonzero(keep[owner] & ((label[owner] == 0) | (r == 0) | (every == worst[owner])))
        y = label[owner[sel]]
        weight = trust[owner[sel]] * np.where(y == 1, 1.5, 1.0)
        for _ in range(steps):
            s, vv, s1 = raw(sel)
            g = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(sel)
            gw = np.bincount(idx[sel].ravel(), weights=np.repeat(g, WINDOW), minlength=n) + 2e-5 * w
            each = (g[:, None, None] * (s1[:, None, :] - vv)).reshape(-1, RANK)
            flat = idx[sel].ravel()
            gv = np.stack([np.bincount(flat, weights=each[:, f], minlength=n) for f in range(RANK)], axis=1) + 5e-5 * v
            gw[0], gv[0] = 0, 0
            w0 -= 0.3 * g.sum()
            t += 1
            for k, (p, gr) in enumerate(((w, gw), (v, gv))):
                m[k] = 0.9 * m[k] + 0.1 * gr
                g2[k] = 0.99 * g2[k] + 0.01 * gr * gr
                p -= 0.08 * (m[k] / (1 - 0.9**t)) / (np.sqrt(g2[k] / (1 - 0.99**t)) + 1e-7)
            w[0], v[0] = 0, 0
        every, _, _ = raw(np.arange(len(items)))
        worst = np.full(len(bags), -np.inf)
        np.maximum.at(worst, owner, every)
        odd = (label == 0) & (worst > 1.5) | (label == 1) & (worst < -1.5)
        keep = ~odd | (trust == 4.0)
    # words that may stand masked: seen in abusive rows, hardly in others
    bad = {x for x, (no, yes) in counts.items() if yes and no * 4 <= yes and len(x) >= 4 and w[vocab[term(x)]] > 0.3}
    masked: dict[int, list[str]] = {}
    for x in sorted(bad):
        masked.setdefault(len(x), []).append(x)
    # terms that hardly weigh anything, alone or in pairs, are as good as unknown
    light = (np.abs(w) < 0.15) & ((v * v).sum(axis=1) < 0.05)
    kept = [k for k, i in vocab.items() if not light[i]]
    at = [0] + [vocab[k] for k in kept]
    return Model({k: i for i, k in enumerate(kept, 1)}, w[at], v[at], w0, masked)


def fit_table(labels: DataFrame, docs: DataFrame, limit: int = MAX_LABELLED, background: int = MAX_BACKGROUND) -> Model:
    """The model of ``labels (label_id, text, label)`` and of weakly labelled ``docs (rec_id, text, _toxicity_score)``.

    Null and unclear labels are left out; at most ``limit`` rows are used, by least id. Of
    the documents that the loose score calls harmless at most ``background`` are used, by hash.
    """
    rows = labels.where("text IS NOT NULL AND label IN ('none', 'abusive', 'hateful', 'sexual')").orderBy("label_id").limit(limit).select("text", "label").collect()
    weak = docs.where("text IS NOT NULL AND text <> '' AND _toxicity_score < 0.1 AND length(text) < 20000")
    calm = lex.sampled_texts(weak, "rec_id", "text", background)
    return fit([(r["text"], r["label"] != "none") for r in rows], calm)


def _score(model: Model):
    def run(pdfs):
        for whole in pdfs:
            for pdf in lex.batches([whole], 1000):
                text = model.score(pdf["text"].tolist())
                url = model.score([url_words(u) for u in pdf["url"]])
                yield pd.DataFrame({"rec_id": pdf["rec_id"], "source": pdf["source"], "text_score": text, "url_score": url})

    return run


def abuse_scores(df: DataFrame, model: Model) -> DataFrame:
    """``rec_id, source, text_score, url_score, score, is_abusive`` of every row of ``(rec_id, text, url, source)``.

    score is the higher of both. A null or empty text or url scores 0.
    """
    rows = spread(df.select("rec_id", "text", "url", "source"), "rec_id")
    out = rows.mapInPandas(_score(model), "rec_id bigint, source string, text_score double, url_score double")
    return out.withColumn("score", F.greatest("text_score", "url_score")).withColumn("is_abusive", F.col("score") >= THRESHOLD)
