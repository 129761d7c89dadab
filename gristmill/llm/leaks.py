"""Evaluation texts leaking into training text (problem 9).

The words of a shard of documents, as dense numbers, get a suffix array (by doubling of
ranks, to the order of the first ``SEED`` words). Every suffix of every test item is
binary-searched in the array of every shard, which gives all places where ``SEED`` words
match; each is then followed word by word to its longest verbatim match, as the full order
would give it. Matches of one item in one document that follow closely upon one another are
put together; where they cover enough of the item, an alignment of the words decides whether
the document holds a passage of at least half of the item in which at most one word in eight
differs.

A passage of n words with n / 8 of them changed, put in or left out keeps n / 2, a quarter
of the item at least, in runs of ``SEED`` words or more, and no two such runs lie more than
n / 2 words apart, wherever the changes stand: a change spoils ``SEED`` words at most. So
matches belong together up to half of the item apart, and no case is lost before the
alignment. An item of fewer than ``SEED`` words is only found as a whole.
"""
from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import lex
from gristmill.sources.tables import spread

SEED = 4
MIN_PART, MAX_CHANGED, MIN_COVER = 0.5, 1 / 8, 0.25
#: Words of a shard; items of one block of the query set.
SHARD, ITEMS = 600_000, 4_000


class SuffixArray:
    """Suffixes of a sequence of words in the order of their first ``2 ** doublings`` words."""

    def __init__(self, hashes: np.ndarray, doublings: int = 2):
        self.words, rank = np.unique(hashes, return_inverse=True)
        self.tokens = rank.astype(np.int64)
        rank = self.tokens + 1
        width = 1
        for _ in range(doublings):
            nxt = np.zeros_like(rank)
            nxt[:-width] = rank[width:]
            rank = np.unique(rank * (rank.max() + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        self.padded = np.concatenate([self.tokens, np.full(width, -1)])

    def ranks_of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the given words in this sequence; -2 for a word that doesn't occur."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        return np.where(self.words[at] == hashes, at, -2) if len(self.words) else np.full(len(hashes), -2)

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``query`` (words by number) the range of the array whose suffixes begin with it."""
        depth = query.shape[1]
        cols = np.arange(depth)

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) // 2
                suffix = self.padded[self.order[np.minimum(mid, len(self.order) - 1)][:, None] + cols]
                diff = suffix != query
                first = np.where(diff.any(axis=1), diff.argmax(axis=1), depth - 1)
                rows = np.arange(len(query))
                a, b = suffix[rows, first], query[rows, first]
                less = a <= b if after else a < b
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)

        return bound(False), bound(True)


def _passage(item: list[str], window: list[str]) -> tuple[int, int]:
    """(words of the longest stretch of the item that the window holds within the tolerance, its longest verbatim run)."""
    match = np.zeros(len(item), bool)
    run = 0
    extra = np.zeros(len(item), np.int64)
    last = None
    for b in difflib.SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks():
        if b.size:
            match[b.a : b.a + b.size] = True
            run = max(run, b.size)
            if last is not None:  # words put in between count as changes, too
                extra[b.a] = max(0, (b.b - last.b - last.size) - (b.a - last.a - last.size))
            last = b
    score = np.where(match, MAX_CHANGED, MAX_CHANGED - 1.0)
    # within a stretch that begins at a, insertions before a don't count
    total = np.concatenate([[0.0], np.cumsum(score - extra)])
    best = 0
    for a in range(len(item)):
        if match[a]:
            ok = np.flatnonzero(total[a + 1 :] - total[a] + extra[a] >= -1e-9)
            if len(ok):
                best = max(best, int(ok[-1]) + 1)
    return best, run


def _search(items: list[tuple[int, list[str]]]):
    """A task's search for the given items; pieces of the partition become shards."""
    usable = [(i, ws) for i, ws in items if ws]

    def matches(array: SuffixArray, numbers: np.ndarray, owner: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the test words and in the shard where ``depth`` words match, for the items in ``wanted``."""
        at = np.arange(len(numbers) - depth + 1)
        at = at[(owner[at] == owner[at + depth - 1]) & wanted[owner[at]]]
        query = np.stack([numbers[at + k] for k in range(depth)], axis=1) if len(at) else np.zeros((0, depth), np.int64)
        known = (query >= 0).all(axis=1)
        at, query = at[known], query[known]
        if not len(at):
            return at, at
        lo, hi = array.find(query)
        n = hi - lo
        which = np.repeat(at, n)
        return which, array.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def shard(ids: list, docs: list[list[str]], cache: lex.Hashes) -> pd.DataFrame:
        empty = pd.DataFrame({"doc_id": np.zeros(0, np.int64), "item_id": np.zeros(0, np.int64), "passage_words": np.zeros(0, np.int32), "verbatim_words": np.zeros(0, np.int32)})
        flat, starts = lex.flat_hashes(docs, cache)
        if not len(flat) or not usable:
            return empty
        array = SuffixArray(flat)
        test, begin = lex.flat_hashes([ws for _, ws in usable], cache)
        numbers = array.ranks_of(test)
        sizes = np.diff(begin)
        owner = np.repeat(np.arange(len(usable)), sizes)
        rows: dict[tuple[int, int], tuple[int, int]] = {}

        def keep(d: int, i: int, part: int, run: int) -> None:
            if part > rows.get((d, i), (0, 0))[0]:
                rows[d, i] = (part, max(run, rows.get((d, i), (0, 0))[1]))

        for k in range(1, SEED):  # short items, as a whole
            t, place = matches(array, numbers, owner, k, sizes == k)
            doc = np.searchsorted(starts, place, "right") - 1
            for d, i in sorted(set(zip(doc[place + k <= starts[doc + 1]].tolist(), owner[t[place + k <= starts[doc + 1]]].tolist()))):
                keep(d, i, k, k)
        t, place = matches(array, numbers, owner, SEED, sizes >= SEED)
        doc = np.searchsorted(starts, place, "right") - 1
        inside = place + SEED <= starts[doc + 1]
        t, place, doc = t[inside], place[inside], doc[inside]
        if len(t):
            item = owner[t]
            # how far the words go on matching, all matches one word at a time while any does
            length = np.full(len(t), SEED)
            going = np.arange(len(t))
            while len(going):
                a, b = t[going] + length[going], place[going] + length[going]
                more = (a < begin[item[going] + 1]) & (b < starts[doc[going] + 1])
                going, a, b = going[more], a[more], b[more]
                going = going[numbers[a] == array.tokens[b]]
                length[going] += 1
            order = np.lexsort((t, place, item, doc))
            d, i, q, pl, run = doc[order], item[order], (t - begin[item])[order], place[order], length[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (pl[1:] - pl[:-1] > sizes[i[1:]] // 2 + 2 * SEED)
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            # words of the item that the matches of a group cover, each once
            wide = int(sizes.max()) + 1
            held = np.unique(group * wide + q)
            of, q_at = held // wide, held % wide
            add = np.full(len(held), SEED)
            add[1:] = np.where(of[1:] == of[:-1], np.minimum(SEED, q_at[1:] - q_at[:-1]), SEED)
            cover = np.bincount(of, weights=add, minlength=len(head))
            # the windows that the matches of a group point to, some words wider
            size = sizes[i[head]]
            first = np.minimum.reduceat(pl - q, head) - starts[d[head]] - size // 8 - SEED
            last = np.maximum.reduceat(pl - q, head) - starts[d[head]] + size + size // 4 + SEED
            longest = np.maximum.reduceat(run, head)
            for g in np.flatnonzero(cover >= MIN_COVER * size):
                ws = usable[i[head[g]]][1]
                part = _passage(ws, docs[d[head[g]]][max(0, first[g]) : last[g]])[0]
                if part >= MIN_PART * len(ws):
                    keep(int(d[head[g]]), int(i[head[g]]), part, int(longest[g]))
        if not rows:
            return empty
        return pd.DataFrame({
            "doc_id": [ids[d] for d, _ in rows], "item_id": [usable[i][0] for _, i in rows],
            "passage_words": [p for p, _ in rows.values()], "verbatim_words": [r for _, r in rows.values()],
        })

    def run(pdfs):
        cache = lex.Hashes()
        ids: list = []
        docs: list[list[str]] = []
        size = 0
        for pdf in pdfs:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ws = lex.words(text)
                ids.append(i)
                docs.append(ws)
                size += len(ws)
                if size >= SHARD:
                    yield shard(ids, docs, cache)
                    ids, docs, size = [], [], 0
        if docs:
            yield shard(ids, docs, cache)

    return run


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, passage_words, verbatim_words`` of every leak of ``items (item_id, prompt)`` into ``docs (doc_id, text)``.

    The items are the query set: they go to the tasks in blocks of ``ITEMS``, each block
    over all documents. Null and empty texts and prompts have no leaks; prompts of fewer
    than ``SEED`` words are found as a whole only. Repeated ids of documents
    give a row each time they hold a passage; repeated item ids likewise.
    """
    queries = [(r["item_id"], lex.words(r["prompt"])) for r in items.where("prompt IS NOT NULL").select("item_id", "prompt").toLocalIterator()]
    rows = spread(docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text"), "doc_id")
    out = None
    for i in range(0, max(1, len(queries)), ITEMS):
        part = rows.mapInPandas(_search(queries[i : i + ITEMS]), "doc_id bigint, item_id bigint, passage_words int, verbatim_words int")
        out = part if out is None else out.unionByName(part)
    return out
