"""Filling containers of fixed capacity (problem 8).

Documents are spread over groups by hash, some hundred containers' worth to each, and each
group is packed by bounded-space online best-fit: a fixed number of bins is open, a bitset
over their free spaces finds the tightest one that takes an item, and when a new bin is
needed while all are open the fullest is closed. Only an item larger than a container is
split, into full containers and a rest that is packed like any other item.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import tokens
from gristmill.operators.components import checkpointed
from gristmill.sources.tables import spread

OPEN_BINS = 64
#: Containers' worth of tokens in one group.
GROUP = 1_000


class Bins:
    """Open bins by free space, as a bitset with a stack of bins at every set bit."""

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.open = 0
        self.used = 0

    def _take(self, free: int) -> int:
        stack = self.at[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def _put(self, b: int, free: int) -> None:
        self.at.setdefault(free, []).append(b)
        self.bits |= 1 << free
        self.open += 1

    def add(self, size: int) -> int:
        """The number of the bin that takes an item of ``size`` <= capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:  # the fullest is closed
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.used
            self.used += 1
        self._put(b, free - size)
        return b


def pack(sizes: list[int], capacity: int, separator: int, limit: int = OPEN_BINS) -> list[list[tuple[int, int]]]:
    """For each item its pieces ``(bin, tokens)``; every piece is followed by a separator."""
    room = capacity - separator
    if room <= 0:
        raise ValueError("a separator leaves no room in a container")
    bins = Bins(capacity, limit)
    out = []
    for n in sizes:
        pieces = []
        while n > room:
            pieces.append((bins.used, room))
            bins.used += 1
            n -= room
        pieces.append((bins.add(n + separator), n))
        out.append(pieces)
    return out


def _sizes(folder: str):
    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": tokens.count_tokens(pdf["text"], folder)})

    return run


def sizes(docs: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``(doc_id, text)``; null and empty texts have none."""
    return spread(docs.select("doc_id", "text"), "doc_id").mapInPandas(_sizes(folder), "doc_id bigint, n_tokens bigint")


def _fill(pdfs):
    """Groups follow one another in a partition; the bins of one are dropped when the next begins."""
    now, bins = None, None
    for pdf in pdfs:
        rows: dict[str, list] = {"spec_id": [], "doc_id": [], "n_tokens": [], "part_no": [], "n_parts": [], "container_id": [], "part_tokens": []}
        for spec, group, cap, sep, doc, n in zip(*(pdf[c].tolist() for c in ("spec_id", "grp", "capacity_tokens", "separator_tokens", "doc_id", "n_tokens"))):
            if (spec, group) != now:
                now, bins = (spec, group), Bins(cap)
            room, rest, pieces = cap - sep, n, []
            while rest > room:
                pieces.append((bins.used, room))
                bins.used += 1
                rest -= room
            pieces.append((bins.add(rest + sep), rest))
            for k, (b, size) in enumerate(pieces):
                for name, value in zip(rows, (spec, doc, n, k, len(pieces), (group << 32) + b, size)):
                    rows[name].append(value)
        yield pd.DataFrame(rows)


def packed(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, doc_id, n_tokens, part_no, n_parts, container_id, part_tokens`` for all documents and each spec.

    ``sized`` holds ``doc_id, n_tokens``, ``specs`` a few rows ``spec_id, capacity_tokens,
    separator_tokens``; specs with nulls or without room beside the separator raise. A
    document without tokens takes a separator's room. Rows of the same id are packed each.
    """
    sized = checkpointed(sized)
    total = sized.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    parts = []
    for s in specs.select("spec_id", "capacity_tokens", "separator_tokens").collect():
        if s["capacity_tokens"] is None or s["separator_tokens"] is None or s["separator_tokens"] >= s["capacity_tokens"]:
            raise ValueError(f"spec {s['spec_id']} leaves no room")
        groups = max(1, math.ceil(((total["t"] or 0) + total["n"] * s["separator_tokens"]) / (s["capacity_tokens"] * GROUP)))
        parts.append(
            sized.select(
                F.lit(s["spec_id"]).cast("bigint").alias("spec_id"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups)).cast("bigint").alias("grp"),
                F.lit(s["capacity_tokens"]).cast("bigint").alias("capacity_tokens"), F.lit(s["separator_tokens"]).cast("bigint").alias("separator_tokens"), "doc_id", "n_tokens",
            )
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.repartition("spec_id", "grp").sortWithinPartitions("spec_id", "grp", F.xxhash64("doc_id"), "doc_id", "n_tokens")
    return rows.mapInPandas(_fill, "spec_id bigint, doc_id bigint, n_tokens bigint, part_no int, n_parts int, container_id bigint, part_tokens bigint")
