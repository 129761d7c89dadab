"""Near duplicates by min-hash signatures, banding, and connected components."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.components import checkpointed, connected_components
from gristmill.sources.tables import spread

N_HASHES, BANDS, SHINGLE, THRESHOLD = 128, 8, 5, 0.8
#: A prime above 2^32; coefficients stay below 2^31, so that products fit 63 bits.
PRIME = 4_294_967_311


def coefficients(n: int = N_HASHES) -> tuple[list[int], list[int]]:
    """The affine family, from a rule that SQL can follow, too."""
    return [(1_103_515_245 * (i + 1) + 12_345) % 2_147_483_647 for i in range(n)], [(1_664_525 * (i + 7) + 1_013_904_223) % 2_147_483_647 for i in range(n)]


#: Base and modulus of the hash of a shingle, a polynomial over its characters.
BASE, MODULUS = 1_000_003, 4_294_967_291


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, below 2^32, of all runs of ``n`` characters; of the whole text if it is shorter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = min(n, len(c))
    if not n:
        return np.zeros(1, np.uint64)
    h = c[: len(c) - n + 1]
    for k in range(1, n):
        h = (h * np.uint64(BASE) + c[k : len(c) - n + 1 + k]) % np.uint64(MODULUS)
    return np.unique(h)


def signatures(df: DataFrame, id_col: str, text_col: str, n_hashes: int = N_HASHES) -> DataFrame:
    """``id, sig`` of every row, from shingles of characters of the lower-case text with single blanks."""
    a, b = (np.array(x, dtype=np.uint64) for x in coefficients(n_hashes))

    @F.pandas_udf("array<bigint>")
    def sign(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            h = shingle_hashes(t)
            least = np.full(n_hashes, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(h), 4096):  # a very long text in pieces
                least = np.minimum(least, ((a[:, None] * h[None, i : i + 4096] + b[:, None]) % np.uint64(PRIME)).min(axis=1))
            out.append(least.astype(np.int64))
        return pd.Series(out)

    rows = spread(df.select(F.col(id_col).alias("id"), T.fingerprint_text(F.col(text_col)).alias("t")), "id")
    return rows.select("id", sign("t").alias("sig"))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.size(a)


def band_rows(sigs: DataFrame, bands: int = BANDS) -> DataFrame:
    """``id, band, bucket`` of every signature and band."""
    width = F.floor(F.size("sig") / bands).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("sig", i * width + 1, width)))
    return sigs.select("id", F.posexplode(cut).alias("band", "bucket"))


#: Copies from which on the class of a signature is broadcast instead of joined, at least.
HOT = 10_000


def classes(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, rep``; ``id, sig`` of the representatives) of equal signatures.

    Classes go by 64 bits of their signature. Those with very many members are few, whatever
    the corpus (at most 100,000 hold 1/100,000 of the rows each); they are broadcast, so that
    their members stay where they are.
    """
    keyed = sigs.select("id", F.xxhash64("sig").alias("k"), "sig")
    reps = checkpointed(keyed.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")))
    many = max(HOT, (reps.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot = F.broadcast(reps.where(F.col("n") > many).select("k", F.col("rep").alias("_hot")))
    known = keyed.select("id", "k").join(hot, "k", "left")
    rest = known.where("_hot IS NULL").select("id", "k").join(reps.where(F.col("n") <= many).select("k", "rep"), "k")
    member = known.where("_hot IS NOT NULL").select("id", F.col("_hot").alias("rep")).unionByName(rest.select("id", "rep"))
    return member, reps.select(F.col("rep").alias("id"), "sig")


#: Members of a bucket that are compared at once; a larger bucket is split into pairs of blocks.
BLOCK = 512


def _links(threshold: float, spanning: bool):
    """Compares the members of each bucket; rows come sorted by bucket."""

    def bucket(ids: np.ndarray, side: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int, float]]:
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i in range(len(ids) - 1):
            other = (side[i + 1 :] == 0) | (side[i + 1 :] != side[i])
            sim = (sigs[i + 1 :] == sigs[i]).mean(axis=1)
            for j in np.flatnonzero(other & (sim >= threshold)) + i + 1:
                if spanning:
                    x, y = find(i), find(int(j))
                    if x == y:
                        continue
                    root[y] = x
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(sim[j - i - 1])))
        return out

    def run(pdfs):
        rest = None
        for pdf in pdfs:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cut = int(pdf["key"].searchsorted(pdf["key"].iloc[-1], "left")) if len(pdf) else 0
            rest, pdf = pdf.iloc[cut:], pdf.iloc[:cut]
            yield _frame(pdf)
        if rest is not None and len(rest):
            yield _frame(rest)

    def _frame(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, g in pdf.groupby("key", sort=False):
            rows += bucket(g["id"].to_numpy(), g["side"].to_numpy(), np.stack(g["sig"].to_list()))
        return pd.DataFrame(rows, columns=["a", "b", "sim"]).astype({"a": "int64", "b": "int64", "sim": "float64"})

    return run


def similar_pairs(sigs: DataFrame, bands: int = BANDS, threshold: float = THRESHOLD, spanning: bool = False) -> DataFrame:
    """``a < b, sim`` of signatures that share a bucket and agree in ``threshold`` of their places.

    The members of a bucket are compared inside one task, without making their pairs; a
    bucket beyond BLOCK members is split into pairs of blocks. With ``spanning`` only as
    many links of a bucket come out as its components need. Equal signatures should be
    collapsed before.
    """
    rows = band_rows(sigs, bands)
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "bucket"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    split = rows.select("id", "band", "bucket", mine.alias("m"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    split = split.select("id", F.xxhash64("band", "bucket", F.least("m", "o"), F.greatest("m", "o")).alias("key"), F.when(F.col("m") == F.col("o"), 0).when(F.col("m") < F.col("o"), 1).otherwise(2).alias("side"))
    parts = sigs.sparkSession.sparkContext.defaultParallelism * 2
    full = split.join(sigs, "id").repartition(parts, "key").sortWithinPartitions("key", "id")
    return full.select("key", "id", "side", "sig").mapInPandas(_links(threshold, spanning), "a bigint, b bigint, sim double").dropDuplicates(["a", "b"])


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, threshold: float = THRESHOLD, n_hashes: int = N_HASHES) -> DataFrame:
    """``id, cluster`` of every row, the cluster named by its least id; copies are one class before any pair is made."""
    sigs = checkpointed(signatures(df, id_col, text_col, n_hashes))
    member, reps = classes(sigs)
    parts = connected_components(similar_pairs(reps, bands, threshold, spanning=True))
    return member.join(parts, member["rep"] == parts["node"], "left").select("id", F.coalesce("component", "rep").alias("cluster"))
