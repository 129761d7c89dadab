"""Near-duplicate records (problem 1).

Texts become sets of hashed shingles of consecutive words; equal sets are collapsed to
one class first. Every class gets ``BANDS * ROWS`` min-hashes; the top bit of each is its
sketch of 128 bits, in which two sets of Jaccard similarity J agree with probability
(1+J)/2. Classes that share a band are compared by the Hamming distance of the sketches:
bit planes are stored vertically (one lane per class, in bucket order), the planes are
XORed with themselves shifted by s lanes, which compares every lane with the s-th next of
its bucket at once, and carry-save counters add the planes up. Whole words of 64 lanes
are abandoned as soon as all their distances exceed the radius. What remains is verified
by the Jaccard similarity of the shingle sets, as sets of 32-bit hashes: these, not the
texts, are sent to where a pair is compared. Two different shingles of a pair of texts of
400 words have the same hash in one of some 25,000 pairs, which moves its similarity by a
three-hundredth at most.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import lex
from gristmill.operators.components import checkpointed, connected_components
from gristmill.sources.tables import spread

#: 32 bands of 4 rows: at a similarity of 0.65 a pair shares a band with probability 0.998, at 0.7 with 0.9998.
BANDS, ROWS = 32, 4
BITS = BANDS * ROWS
#: Sketch bits that may differ. At a similarity of 0.65 the expected distance is 22.4 with a deviation of 4.3.
RADIUS = 46
#: Lanes of one comparison block; a bucket of more members is split into pairs of blocks.
BLOCK = 2048
#: Copies from which on the class of a text is broadcast instead of joined, at least.
HOT = 10_000
#: Ids up to this number are broadcast (8 bytes each, some 50 MB as a table).
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20240131)
_MUL = _rng.integers(1, 2**32, BITS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BITS, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(docs: list[list[str]], n: int, cache: lex.Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the number of the document of each."""
    flat, starts = lex.flat_hashes(docs, cache)
    lengths = np.diff(starts)
    doc = np.repeat(np.arange(len(docs)), lengths)
    total = len(flat)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = flat[: total - n + 1].copy()
    for k in range(1, n):
        h = lex.mix(h + np.uint64(0x9E3779B97F4A7C15)) ^ flat[k : total - n + 1 + k]
    h = lex.mix(h)
    whole = doc[: total - n + 1] == doc[n - 1 :]
    return h[whole], doc[: total - n + 1][whole]


def sets(texts: list[str], n: int, cache: lex.Hashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text of fewer than ``n`` words."""
    h, doc = shingle_hashes([lex.words_han(t) for t in texts], n, cache)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [h[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def minhashes(s: np.ndarray) -> np.ndarray:
    """BITS min-hashes of a set, as uint32."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.empty(BITS, np.uint32)
    for i in range(0, BITS, 16):
        x = low[None, :] * _MUL[i : i + 16, None]
        x += _ADD[i : i + 16, None]
        out[i : i + 16] = x.min(axis=1)
    return out


def _sign(n: int):
    def run(pdfs):
        import xxhash

        cache = lex.Hashes()
        for whole in pdfs:
            for pdf in lex.batches([whole]):
                texts = pdf["text"].tolist()
                digest, bands, sketch = [], [], []
                for text, s in zip(texts, sets(texts, n, cache)):
                    if not len(s):
                        # too short for a shingle: only an equal text is alike
                        digest.append(xxhash.xxh128_digest("\0" + text))
                        bands.append([])
                        sketch.append(b"")
                        continue
                    m = minhashes(s)
                    digest.append(xxhash.xxh128_digest(s.tobytes()))
                    b = m.reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        key = lex.mix(key * np.uint64(0x100000001B3) ^ b[:, r])
                    bands.append(key.view(np.int64))
                    bit = lex.mix(m.astype(np.uint64)) >> np.uint64(63)
                    sketch.append(np.packbits(bit.astype(np.uint8)).tobytes())
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "digest": digest, "bands": bands, "sketch": sketch})

    return run


def lane_planes(sketches: np.ndarray) -> np.ndarray:
    """Sketches of shape (lanes, BITS/8) as vertical planes of shape (BITS, words): one bit per lane."""
    lanes = len(sketches)
    bits = np.unpackbits(sketches, axis=1).T
    pad = -lanes % 64
    if pad:
        bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def _shifted(planes: np.ndarray, s: int, words: np.ndarray) -> np.ndarray:
    """The given words of ``planes`` as they are with every lane moved down by s."""
    whole, part = divmod(s, 64)
    width = planes.shape[1]
    low = words + whole
    a = np.where(low < width, planes[:, np.minimum(low, width - 1)], np.uint64(0))
    if not part:
        return a
    b = np.where(low + 1 < width, planes[:, np.minimum(low + 1, width - 1)], np.uint64(0))
    return (a >> np.uint64(part)) | (b << np.uint64(64 - part))


def close_lanes(planes: np.ndarray, s: int, mask: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes in ``mask`` whose sketch is within ``radius`` of that of the lane s further on.

    Counts differing planes in vertical counters, eight planes at a time through
    carry-save adders, and goes on only with words that still hold a lane within the radius.
    """
    words = np.flatnonzero(mask)
    alive = mask[words]
    width = (BITS + 1).bit_length()
    counter = [np.zeros(len(words), np.uint64) for _ in range(width)]

    def add(x: np.ndarray, at: int) -> None:
        for i in range(at, width):
            counter[i], x = counter[i] ^ x, counter[i] & x

    def csa(a, b, c):
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    for at in range(0, BITS, 8):
        if not len(words):
            break
        d = planes[at : at + 8][:, words] ^ _shifted(planes[at : at + 8], s, words)
        one, two_a = csa(d[0], d[1], d[2])
        one, two_b = csa(one, d[3], d[4])
        one, two_c = csa(one, d[5], d[6])
        two, four = csa(two_a, two_b, two_c)
        add(one, 0)
        add(two, 1)
        add(four, 2)
        add(d[7], 0)
        if at % 32 == 24:
            # counter > radius, from the highest bit down
            over, same = np.zeros(len(words), np.uint64), ~np.zeros(len(words), np.uint64)
            for i in reversed(range(width)):
                if radius >> i & 1:
                    same = same & counter[i]
                else:
                    over |= same & counter[i]
                    same = same & ~counter[i]
            alive = alive & ~over
            live = alive != 0
            if not live.all():
                words, alive = words[live], alive[live]
                counter = [c[live] for c in counter]
    out = np.zeros(len(mask), np.uint64)
    out[words] = alive
    return out


def bucket_pairs(bucket: np.ndarray, side: np.ndarray, ids: np.ndarray, sketches: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lanes of one bucket within ``radius``; rows must be sorted by bucket.

    ``side`` is 0 for a whole bucket; lanes of sides 1 and 2 are only compared with each other.
    """
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0]
    start = np.ones(n, bool)
    start[1:] = bucket[1:] != bucket[:-1]
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, n))
    after = np.repeat(first + size, size) - np.arange(n) - 1  # lanes of the bucket that follow
    keep = np.repeat(size, size) > 1
    bucket, side, ids, sketches, after = bucket[keep], side[keep], ids[keep], sketches[keep], after[keep]
    n = len(ids)
    if not n:
        return ids, ids
    planes = lane_planes(sketches)
    pad = planes.shape[1] * 64
    left, right = [], []
    for s in range(1, int(after.max()) + 1):
        lanes = np.zeros(pad, np.uint8)
        at = np.flatnonzero(after >= s)
        lanes[at[(side[at] == 0) | (side[at] != side[at + s])]] = 1
        mask = np.packbits(lanes, bitorder="little").view(np.uint64)
        hit = close_lanes(planes, s, mask, radius)
        found = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        left.append(ids[found])
        right.append(ids[found + s])
    return np.concatenate(left), np.concatenate(right)


def _compare(pdfs):
    """Buckets, sorted by key, cut into pieces between buckets; partial buckets wait for the next batch."""
    rest = None
    for pdf in pdfs:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        rest, pdf = pdf.iloc[last:].reset_index(drop=True), pdf.iloc[:last]
        if len(pdf):
            yield _pairs(pdf)
    if rest is not None and len(rest):
        yield _pairs(rest)


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BITS // 8)
    a, b = bucket_pairs(pdf["key"].to_numpy(), pdf["side"].to_numpy(), pdf["cid"].to_numpy(), sketches)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _sets(n: int):
    """The sets of the texts, as bytes of sorted 32-bit hashes."""
    def run(pdfs):
        cache = lex.Hashes()
        for pdf in lex.batches(pdfs):
            made = [np.unique(s.astype(np.uint32)).tobytes() for s in sets(pdf["text"].tolist(), n, cache)]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "hashes": made})

    return run


def _verify(threshold: float):
    def run(pdfs):
        for pdf in lex.batches(pdfs):
            sim = []
            for x, y in zip(pdf["hashes_a"], pdf["hashes_b"]):
                both = np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())  # each set holds a hash once
                sim.append(common / max(1, len(both) - common))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sim})
            yield out[out["similarity"] >= threshold]

    return run


def classes(docs: DataFrame, n: int = 5) -> DataFrame:
    """``(id, digest, bands, sketch, cid)`` of every row of a non-empty text; cid is the least id of the rows of the same shingle set."""
    texts = spread(docs.where("id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("id", "text"), "id")
    signed = texts.mapInPandas(_sign(n), "id bigint, digest binary, bands array<bigint>, sketch binary")
    return checkpointed(signed)


def links(signed: DataFrame, docs: DataFrame, n: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership ``id, cid``; verified links ``a, b, similarity`` between different classes)."""
    spark = docs.sparkSession
    parts = spark.sparkContext.defaultParallelism * 4
    # bands and sketch depend on the digest alone, so those of any of its rows are the class's
    reps = checkpointed(signed.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    # texts with very many copies are few, whatever the corpus: at most 100,000 of them hold 1/100,000 of the rows each;
    # their classes are broadcast, so that their copies stay where they are
    many = max(HOT, signed.count() // 100_000)
    hot = F.broadcast(reps.where(F.col("n_copies") > many).select("digest", F.col("cid").alias("_hot")))
    known = signed.select("id", "digest").join(hot, "digest", "left")
    rest = known.where("_hot IS NULL").select("id", "digest").join(reps.where(F.col("n_copies") <= many).select("digest", "cid"), "digest")
    member = known.where("_hot IS NOT NULL").select("id", F.col("_hot").alias("cid")).unionByName(rest.select("id", "cid"))
    # counted and joined on one and the same exchange of (class, band key)
    rows = reps.select("cid", F.explode("bands").alias("key")).repartition(parts, "key")
    sizes = rows.groupBy("key").agg(F.count("cid").alias("n")).where("n > 1")  # of the column, so that both sides need the same exchange
    # keys of one member are gone after this join; what is left are classes that share a band, and only they get their sketch
    rows = rows.join(sizes, "key").join(reps.select("cid", "sketch"), "cid")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    plain = rows.where(f"n <= {BLOCK}").select("cid", "sketch", "key", F.lit(0).alias("side"))
    # a hot bucket: each member meets every block, so that no task holds more than two blocks
    hot = (
        rows.where(f"n > {BLOCK}")
        .select("cid", "sketch", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(
            "cid", "sketch",
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        )
    )
    near = plain.union(hot).repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_compare, "a bigint, b bigint").distinct()
    near = checkpointed(near)
    texts = docs.where("id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("id", "text")
    wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    # few ids are broadcast, so that only the hashes of the texts wanted are shuffled, not all texts; many are joined by a shuffle
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hashes = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInPandas(_sets(n), "id bigint, hashes binary")
    pairs = near.join(hashes.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(
        hashes.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b")), "b"
    )
    edges = pairs.mapInPandas(_verify(threshold), "a bigint, b bigint, similarity double")
    return member, checkpointed(edges)


def near_duplicate_links(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership and links of near-duplicate texts.

    Returns ``member (id, cid)``, one row per row of a non-empty text, and ``edges (a, b,
    similarity)`` between class representatives a < b. Null ids and null or empty texts
    are left out; texts of fewer than ``n`` words are only alike when equal; other columns
    are ignored, whatever their names; an empty table gives empty results.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return links(classes(docs, n), docs, n, threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """All pairs ``rec_a < rec_b``, members of linked and of equal classes expanded.

    Meant for collections whose groups are small; use ``near_duplicate_groups`` where a
    group may hold a large part of all rows.
    """
    member, edges = near_duplicate_links(df, id_col, text_col, n, threshold)
    a = member.select(F.col("id").alias("ia"), F.col("cid").alias("a"))
    b = member.select(F.col("id").alias("ib"), F.col("cid").alias("b"))
    across = edges.select("a", "b").join(a, "a").join(b, "b").select("ia", "ib")
    within = a.join(b, F.col("a") == F.col("b")).where("ia < ib").select("ia", "ib")
    return across.union(within).select(F.least("ia", "ib").alias("rec_a"), F.greatest("ia", "ib").alias("rec_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of a non-empty text: ``rec_id, class_id, group_id, n_copies, n_links``.

    class_id is the least id of the rows with the same shingle set, group_id the least
    one reached over links; n_copies counts the rows of the class, n_links the other
    classes that it is linked with.
    """
    member, edges = near_duplicate_links(df, id_col, text_col, n, threshold)
    groups = connected_components(edges).select(F.col("node").alias("cid"), "component")
    degree = edges.select(F.col("a").alias("cid")).union(edges.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    copies = member.groupBy("cid").agg(F.count("*").alias("n_copies"))
    per_class = copies.join(groups, "cid", "left").join(degree, "cid", "left")
    return member.join(per_class, "cid").select(
        F.col("id").alias("rec_id"), F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
