"""Personal information in free text (problem 7).

A linear-chain conditional random field over word-shape features labels the tokens of a
text; it is trained on a small labelled table (labelled_pii) by maximum likelihood and
decoded by Viterbi in numpy batches. Tokens whose features speak so strongly against any
entity that no transition could outweigh it are not decoded; what is decoded are the
stretches around the others. A plausibility check of each found span follows.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import labelled_pii, lex
from gristmill.sources.tables import spread

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
N = len(LABELS)
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: Tokens of context that are decoded on each side of a token that may belong to an entity.
CONTEXT = 6
LONGEST = 96
#: Weight of the single tokens' likelihood beside the field's.
ALONE = 0.25

TOKEN = re.compile(rf"\d+|[{lex.HAN}]|[^\W\d_{lex.HAN}]+|\n|[^\w\s]|_")
_STREET = frozenset("street st road rd avenue ave drive lane close row court terrace way straße strasse str weg gasse allee platz rue chemin avenue place impasse calle plaza avenida camino".split())
_NUMBER = frozenset("zero one two three four five six seven eight nine".split())
_ENDINGS = ("straße", "strasse", "weg", "gasse", "allee", "platz", "str")


def _shape(t: str) -> str:
    if t.isdigit():
        return f"d{min(len(t), 9)}"
    if not t[0].isalpha():
        return t
    if re.match(f"[{lex.HAN}]", t):
        return "han"
    if len(t) == 1:
        return "X" if t.isupper() else "x"
    if t.isupper():
        return "XX"
    if t[0].isupper():
        return "Xx"
    return "xx" if t.islower() else "xX"


def features(t: str, vocab: frozenset[str] | None) -> tuple[str, ...]:
    """Features of one token by itself; words outside of ``vocab`` only count by their shape."""
    low = t.lower()
    out = ["s:" + _shape(t)]
    if t.isalpha():
        if vocab is None or low in vocab:
            out.append("w:" + low)
        if t[0].isupper() and low.capitalize() in labelled_pii.GIVEN:
            out.append("given")
        if len(low) > 5 and t[0].isupper() and low.endswith(labelled_pii.PLACE_ENDS):
            out.append("place_end")
        if t in labelled_pii.HAN_SURNAMES:
            out.append("han_surname")
        if low in _STREET:
            out.append("street")
        elif len(low) > 5 and low.endswith(_ENDINGS):
            out.append("street_end")
        if low in _NUMBER:
            out.append("number")
        if low in ("example", "test", "invalid", "com", "org", "net", "de", "fr", "es", "co", "uk"):
            out.append("tld")
    return tuple(out)


class Tagger:
    """Weights per token type: ``emit[k][type]`` for a type seen ``OFFSETS[k]`` tokens away."""

    def __init__(self, vocab: frozenset[str], feats: dict[str, int], theta: np.ndarray, trans: np.ndarray, first: np.ndarray):
        self.vocab, self.feats, self.theta, self.trans, self.first = vocab, feats, theta, trans, first
        self.reset()
        # the most that an entity's transitions can give each of its tokens on average
        gains = []
        for b in range(1, N, 2):
            out, into = trans[0, b], [trans[b, :].copy(), trans[b + 1, :].copy()]
            gains.append(out + max(into[0][x] for x in (0, *range(1, N, 2))) - 2 * trans[0, 0])
            for k in range(2, 40):
                leave = max(into[1][x] for x in (0, *range(1, N, 2)))
                gains.append((out + trans[b, b + 1] + (k - 2) * trans[b + 1, b + 1] + leave - (k + 1) * trans[0, 0]) / k)
            gains.append(trans[b + 1, b + 1] - trans[0, 0])
        self.gain = float(max(gains))

    def reset(self) -> None:
        self.types = _Types(self)
        self.keys: dict[tuple, int] = {}
        self.table = np.zeros((1, len(OFFSETS), N), np.float32)  # type 0: beyond the text

    def type_of(self, token: str) -> int:
        fs = features(token, self.vocab)
        t = self.keys.get(fs)
        if t is None:
            ids = [self.feats[f] for f in fs if f in self.feats]
            t = self.keys[fs] = len(self.keys) + 1
            if t >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table) if t > 64 else np.zeros((64, len(OFFSETS), N), np.float32)])
            self.table[t] = self.theta[:, ids].sum(axis=1) if ids else 0
        return t

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of every label at every token of one run of token types with gaps of type 0 between texts."""
        pad = np.concatenate([np.zeros(3, np.int64), ids, np.zeros(3, np.int64)])
        e = np.zeros((len(ids), N), np.float32)
        for k, off in enumerate(OFFSETS):
            e += self.table[pad[3 + off : 3 + off + len(ids)], k]
        return e

    def decode(self, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """``(text, first token, last token + 1, type)`` of every entity."""
        if len(self.types) > 300_000:
            self.types.clear()
        types = self.types
        gap = [0, 0, 0]
        flat: list[int] = []
        starts = []
        for ws in texts:
            starts.append(len(flat))
            flat += [types[w] for w in ws]
            flat += gap
        if not flat:
            return []
        ids = np.array(flat, dtype=np.int64)
        e = self.emissions(ids)
        margin = e[:, 1:].max(axis=1) - e[:, 0]
        may = (margin > -self.gain) & (ids > 0)
        at = np.flatnonzero(may)
        if not len(at):
            return []
        # merge the surroundings of all such tokens into stretches within one text
        text_of = np.searchsorted(starts, at, "right") - 1
        begin_of, end_of = np.array(starts), np.append(starts[1:], len(flat)) - 3
        b = np.maximum(at - CONTEXT, begin_of[text_of])
        f = np.minimum(at + CONTEXT + 1, end_of[text_of])
        new = np.ones(len(at), bool)
        new[1:] = (b[1:] > np.maximum.accumulate(f)[:-1]) | (text_of[1:] != text_of[:-1])
        left = b[new]
        right = np.maximum.reduceat(f, np.flatnonzero(new))
        owner = text_of[new]
        # a very long stretch is cut where its tokens speak most against an entity
        cuts = [(b, f, o) for b, f, o in zip(left, right, owner) if f - b > LONGEST]
        if cuts:
            fine = right - left <= LONGEST
            pieces = [(b, f, o) for b, f, o in zip(left[fine], right[fine], owner[fine])]
            for b, f, o in cuts:
                while f - b > LONGEST:
                    at = b + LONGEST // 2 + int(margin[b + LONGEST // 2 : b + LONGEST].argmin())
                    pieces.append((b, at, o))
                    b = at
                pieces.append((b, f, o))
            pieces.sort()
            left, right, owner = (np.array(x, dtype=np.int64) for x in zip(*pieces))
        path = self.viterbi(e, left, right)
        self.decoded = (int((right - left).sum()), len(flat))
        out = []
        for i in np.flatnonzero((path > 0).any(axis=1)):
            row = path[i]
            j = 0
            n = right[i] - left[i]
            while j < n:
                if row[j] == 0:
                    j += 1
                    continue
                kind = (row[j] - 1) // 2
                k = j + 1
                while k < n and row[k] == 2 * kind + 2:
                    k += 1
                off = left[i] - starts[owner[i]]
                out.append((int(owner[i]), int(off + j), int(off + k), int(kind)))
                j = k
        return out

    def viterbi(self, e: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Best label paths of the stretches ``left[i]:right[i]``, decoded side by side; 0 past their ends."""
        lengths = right - left
        longest = int(lengths.max())
        path = np.zeros((len(left), longest), np.int8)
        order = np.argsort(-lengths, kind="stable")
        left, lengths = left[order], lengths[order]
        score = e[left] + self.first
        back: list[np.ndarray] = []
        final = score.copy()
        for t in range(1, longest):
            n = int(np.searchsorted(-lengths, -t, "left"))  # stretches longer than t come first
            s = score[:n, :, None] + self.trans[None]
            back.append(s.argmax(axis=1).astype(np.int8))
            score[:n] = s.max(axis=1) + e[left[:n] + t]
            final[:n] = score[:n]
        label = final.argmax(axis=1)
        out = np.zeros((len(left), longest), np.int8)
        for t in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, "left"))
            out[:n, t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        path[order] = out
        return path


class _Types(dict):
    """token -> number of its type."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def __missing__(self, token: str) -> int:
        t = self[token] = self.tagger.type_of(token)
        return t


def _labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for text, spans in labelled_pii.rows():
        tokens, labels = [], []
        for m in TOKEN.finditer(text):
            label = 0
            for b, e, kind in spans:
                if b <= m.start() < e:
                    label = 1 + 2 * TYPES.index(kind) + (m.start() > b)
            tokens.append(m[0])
            labels.append(label)
        out.append((tokens, labels))
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 260) -> Tagger:
    """The field fitted by maximum likelihood (forward-backward over padded batches, Adam, weight decay)."""
    data = _labelled()
    counts: dict[str, int] = {}
    names: set[str] = set()
    for tokens, labels in data:
        for w, y in zip(tokens, labels):
            if w.isalpha():
                # words inside names, hosts and places must not be learnt by heart
                if y in (9, 10) or w in labelled_pii._PLACES or w.endswith(labelled_pii.PLACE_ENDS) and w[0].isupper() and len(w) > 5 or w.lower() in labelled_pii.NOUNS or w in labelled_pii._SURNAMES:
                    names.add(w.lower())
                counts[w.lower()] = counts.get(w.lower(), 0) + 1
    drop = names | {w.lower() for w in labelled_pii._PLACES + labelled_pii._SURNAMES} | {g.lower() for g in (*labelled_pii.GIVEN, *labelled_pii._OTHER_GIVEN)} | set("willow lantern kiln saddler tanner orchard ferry alder quarry beacon mill elm".split())
    vocab = frozenset(w for w, c in counts.items() if c > 1 and w not in drop)
    feats: dict[str, int] = {}
    keys: dict[tuple, int] = {(): 0}
    # tokens step by step: those at place t of all sequences, longest sequences first, lie side by side
    data.sort(key=lambda row: -len(row[0]))
    lengths = np.array([len(t) for t, _ in data])
    s, longest = len(data), int(lengths[0])
    active = [int((lengths > t).sum()) for t in range(longest)]
    begin = np.concatenate([[0], np.cumsum(active)])
    table = np.zeros((s, longest + 6), np.int64)
    gold = np.zeros(begin[-1], np.int64)
    for i, (tokens, labels) in enumerate(data):
        for j, w in enumerate(tokens):
            fs = features(w, vocab)
            table[i, j + 3] = keys.setdefault(fs, len(keys))
            gold[begin[j] + i] = labels[j]
            for f in fs:
                feats.setdefault(f, len(feats))
    shifted = [np.concatenate([table[: active[t], t + 3 + off] for t in range(longest)]) for off in OFFSETS]
    fm = np.zeros((len(keys), len(feats)))
    for fs, t in keys.items():
        for f in fs:
            fm[t, feats[f]] = 1
    k = len(OFFSETS)
    params = [np.zeros((k, len(feats), N)), np.zeros((N, N)), np.zeros(N)]
    # an I- label only follows its own B- or I-
    block = np.zeros((N, N))
    for b in range(2, N, 2):
        block[:, b] = -20
        block[b - 1, b] = block[b, b] = 0
    params[1] += block
    start_block = np.where((np.arange(N) % 2 == 0) & (np.arange(N) > 0), -20.0, 0.0)
    params[2] += start_block
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    parts = [slice(begin[t], begin[t + 1]) for t in range(longest)]
    tokens_all = np.arange(len(gold))
    for step in range(1, steps + 1):
        theta, trans, first = params
        e = np.zeros((len(gold), N))
        for o in range(k):
            e += (fm @ theta[o])[shifted[o]]
        et = np.exp(trans)
        ex = np.exp(e - e.max(axis=1, keepdims=True))
        alpha, beta, norm = np.empty_like(ex), np.ones_like(ex), np.empty((len(gold), 1))
        for t in range(longest):
            at = parts[t]
            x = ex[at] * np.exp(first) if t == 0 else (alpha[parts[t - 1]][: active[t]] @ et) * ex[at]
            norm[at] = x.sum(axis=1, keepdims=True)
            alpha[at] = x / norm[at]
        g_trans = np.zeros((N, N))
        for t in range(longest - 2, -1, -1):
            n, nxt = active[t + 1], parts[t + 1]
            w = ex[nxt] * beta[nxt] / norm[nxt]
            beta[begin[t] : begin[t] + n] = w @ et.T
            g_trans += (alpha[begin[t] : begin[t] + n].T @ w) * et
            np.subtract.at(g_trans, (gold[begin[t] : begin[t] + n], gold[nxt]), 1)
        post = alpha * beta
        post /= post.sum(axis=1, keepdims=True)
        # beside the field's likelihood that of each token by itself, so that features of plain
        # text speak against every label and decoding can leave such text out
        flat = post + ALONE * ex / ex.sum(axis=1, keepdims=True)
        flat[tokens_all, gold] -= 1 + ALONE
        grads = [np.zeros_like(theta), g_trans / s, flat[parts[0]].sum(axis=0) / s]
        for o in range(k):
            acc = np.stack([np.bincount(shifted[o], weights=flat[:, c], minlength=len(keys)) for c in range(N)], axis=1)
            grads[0][o] = fm.T @ acc / s + 3e-4 * theta[o]
        for i, (p, gr) in enumerate(zip(params, grads)):
            m1[i] = 0.9 * m1[i] + 0.1 * gr
            m2[i] = 0.98 * m2[i] + 0.02 * gr * gr
            p -= 0.12 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.98**step)) + 1e-8)
        params[1] = np.where(block < 0, -20.0, params[1])
        params[2] = np.where(start_block < 0, -20.0, params[2])
    theta, trans, first = params
    return Tagger(vocab, feats, theta.astype(np.float32), trans.astype(np.float32), first.astype(np.float32))


_SHAPES = {
    "email": re.compile(r"[\w.+-]+(?:\s*[\[({]?\s*\b(?:at|arroba)\b\s*[\])}]?\s*|\s*@\s*)[\w-]+(?:(?:\s*[\[({]?\s*\bdot\b\s*[\])}]?\s*|\s*\.\s*)[\w-]+)+", re.I),
    "phone": re.compile(r"[+(]?[\d\s()+./,;-]*(?:(?:zero|one|two|three|four|five|six|seven|eight|nine)[\s,-]*){0,16}[\d\s()+./-]*(?:ext\.?\s*\d+)?", re.I),
    "id_number": re.compile(r"[A-Z0-9](?:[A-Z0-9]|[ \n/.-](?=[A-Z0-9]))*", re.I),
    "street_address": re.compile(r"[^|»;:@<>=\[\]{}]+"),
    "person_name": re.compile(r"[^\W\d_][\w.,'’·\s-]*"),
}


def plausible(kind: str, text: str, before: str = "") -> bool:
    """Whether a labelled stretch can be what its label says, by its characters alone."""
    if text.count("\n") > 2 or not _SHAPES[kind].fullmatch(text):
        return False
    digits = sum(c.isdigit() for c in text)
    ws = re.findall(r"[^\W\d_]+", text)
    low = [w.lower() for w in ws]
    if kind == "phone":
        if text.count("(") != text.count(")") or _NO_PHONE.search(text):
            return False
        return 7 <= digits + sum(w in _NUMBER for w in low) <= 17
    if kind == "id_number":
        return digits >= 5
    if kind == "street_address":
        return digits >= 1 and any((w.lower() in _STREET and not w.islower()) or w in _ROMANCE or len(w) > 5 and w.lower().endswith(_ENDINGS) or w == "Am" for w in ws)
    if kind == "person_name":
        # which words are a name is for the field to say; here only their form counts
        return 0 < len(ws) <= 6 and max(map(len, ws)) > 1 and len(set(low)) * 2 > len(low) and not digits and not ws[0][0].islower() and not re.search(r"[^\S\n]{2}|\t", text)
    return True


#: A date, a decimal number, a list of numbers.
_NO_PHONE = re.compile(r"\d{4}-\d\d-\d\d|^\d{1,4}\.\d{1,4}(?:\s|,|$)|\d,-?\d|^\d+\)|\.-")
_ROMANCE = frozenset("rue chemin avenue place impasse calle plaza avenida camino".split())
_TITLE = re.compile(r"(?:\b(?:Mrs|Mr|Ms|Dr|Herr|Frau|M|Mme|Sr|Sra|señora?|Señora?)\.?|先生|女士|联系人)\s*$")


_LOOSE = {
    "email": re.compile(_SHAPES["email"].pattern, re.I),
    "phone": re.compile(r"(?:[+(]?\d[\d\s()+./-]{5,}\d(?:\s*ext\.?\s*\d+)?)|(?:(?:zero|one|two|three|four|five|six|seven|eight|nine)[\s,-]*){7,}", re.I),
    "id_number": re.compile(r"(?<![\w-])(?=(?:\w|[ /.-](?=\w)){0,20}\d)[A-Z0-9](?:[A-Z0-9]|[ /.-](?=[A-Z0-9]))*(?<![a-z])"),
}


def refined(kind: str, text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The labelled stretch if it is plausible; else the plausible stretch of the same type that it overlaps."""
    if plausible(kind, text[begin:end], text[max(0, begin - 12) : begin]):
        return begin, end
    if kind not in _LOOSE:
        return None
    at = max(0, begin - 40)
    best = None
    for m in _LOOSE[kind].finditer(text[at : end + 40]):
        b, e = at + m.start(), at + m.end()
        if b < end and e > begin and plausible(kind, text[b:e]) and (best is None or e - b > best[1] - best[0]):
            best = (b, e)
    return best


def entities(tagger: Tagger, texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """``(text, begin, end, type)`` in characters; placeholders of an earlier masking are no entities."""
    found = tagger.decode([TOKEN.findall(t) if t else [] for t in texts])
    out, spans_of = [], {}
    for i, b, e, kind in found:
        if i not in spans_of:
            spans_of = {i: [m.span() for m in TOKEN.finditer(texts[i])]}
        begin, end = spans_of[i][b][0], spans_of[i][e - 1][1]
        span = refined(TYPES[kind], texts[i], begin, end)
        if span and (i, *span, TYPES[kind]) not in out[-3:]:
            out.append((i, *span, TYPES[kind]))
    return out


def mask(tagger: Tagger, texts: list[str | None]) -> list[str | None]:
    """The texts with typed placeholders in place of personal information, otherwise unchanged."""
    by: dict[int, list[tuple[int, int, str]]] = {}
    for i, b, e, kind in entities(tagger, texts):
        by.setdefault(i, []).append((b, e, kind))
    out = list(texts)
    for i, spans in by.items():
        t = texts[i]
        last = len(t)
        for b, e, kind in sorted(spans, reverse=True):
            if e <= last:  # of overlapping stretches the later one is masked
                t = t[:b] + PLACEHOLDERS[kind] + t[e:]
                last = b
        out[i] = t
    return out


def _find(tagger: Tagger):
    def run(pdfs):
        for whole in pdfs:
            for pdf in lex.batches([whole], 1500):
                hits = sorted({(i, kind) for i, _, _, kind in entities(tagger, pdf["text"].tolist())})
                yield pd.DataFrame({"rec_id": pdf["rec_id"].iloc[[i for i, _ in hits]].to_numpy(), "pii_type": pd.Series([k for _, k in hits], dtype=object)})

    return run


def _mask(tagger: Tagger):
    def run(pdfs):
        for whole in pdfs:
            for pdf in lex.batches([whole], 1500):
                yield pd.DataFrame({"rec_id": pdf["rec_id"].to_numpy(), "text": pd.Series(mask(tagger, pdf["text"].tolist()), dtype=object)})

    return run


def personal_types(df: DataFrame) -> DataFrame:
    """``rec_id, pii_type`` once for each type in each row of ``(rec_id, text)``; null and empty texts give none."""
    rows = spread(df.where(F.col("text").isNotNull()).select("rec_id", "text"), "rec_id")
    return rows.mapInPandas(_find(trained()), "rec_id bigint, pii_type string")


def masked_texts(df: DataFrame) -> DataFrame:
    """``rec_id, text`` with placeholders, one row per row; a null text stays null."""
    return spread(df.select("rec_id", "text"), "rec_id").mapInPandas(_mask(trained()), "rec_id bigint, text string")
