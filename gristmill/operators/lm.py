"""Word language models as plain aggregates and joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.components import checkpointed

#: Entries of a model that are broadcast: the most frequent ones, which hold most of all occurrences (a few MB).
HEAD = 50_000


def _looked_up(rows: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the column ``value`` of ``counts``, null where that has none.

    The head of ``counts`` is broadcast; only rows of rarer keys are shuffled, so that no
    task gets all texts that hold a frequent word.
    """
    head = F.broadcast(counts.orderBy(F.desc(value), *keys).limit(HEAD).withColumnRenamed(value, "_head"))
    rows = rows.join(head, keys, "left")
    found = rows.where("_head IS NOT NULL").withColumnRenamed("_head", value)
    rest = rows.where("_head IS NULL").drop("_head").join(counts, keys, "left")
    return found.unionByName(rest)


def unigram_perplexity(train: DataFrame, df: DataFrame, id_col: str, text_col: str = "text", min_tokens: int = 5) -> DataFrame:
    """``id, ppl`` under add-one unigrams of ``train``; null for a text of fewer than ``min_tokens`` words.

    Words are counted inside of each text first; texts without words give no row.
    """
    def counted(x: DataFrame, *keep: str) -> DataFrame:
        return x.select(*keep, F.explode(T.words(F.lower(F.col(text_col)))).alias("w"))

    vocab = checkpointed(counted(train).groupBy("w").agg(F.count("*").alias("c")))
    total = vocab.agg(F.sum("c").cast("double").alias("n"), F.count("*").alias("v"))
    rows = counted(df, id_col).groupBy(id_col, "w").agg(F.count("*").alias("k"))
    p = _looked_up(rows, vocab, ["w"], "c").crossJoin(F.broadcast(total))  # one row
    logp = F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("v") + 1))
    return p.groupBy(id_col).agg(F.sum("k").alias("t"), F.sum(logp * F.col("k")).alias("l")).select(id_col, F.when(F.col("t") >= min_tokens, F.exp(-F.col("l") / F.col("t"))).alias("ppl"))


def bigram_perplexity(train: DataFrame, df: DataFrame, id_col: str, text_col: str = "text", min_tokens: int = 5, weight: float = 0.7) -> DataFrame:
    """``id, ppl`` of every row of ``df`` under interpolated pairs of words of ``train``.

    A pair has ``weight`` times its relative frequency after its first word, the rest from
    add-one unigrams. Null for a text of fewer than ``min_tokens`` words or without pairs;
    every row of ``df`` has one, null and empty texts included. Ids must be unique.
    """
    def pairs(x: DataFrame, *keep: str) -> DataFrame:
        w = T.words(F.lower(F.col(text_col)))
        x = x.select(*keep, w.alias("_w"))
        n = F.size("_w")
        both = F.zip_with(F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return x.select(*keep, F.explode(both).alias("p")).select(*keep, "p.a", "p.b")

    uni = checkpointed(train.select(F.explode(T.words(F.lower(F.col(text_col)))).alias("b")).groupBy("b").agg(F.count("*").alias("cu")))
    bi = checkpointed(pairs(train).groupBy("a", "b").agg(F.count("*").alias("cb")))
    first = bi.groupBy("a").agg(F.sum("cb").alias("ca"))
    total = uni.agg(F.coalesce(F.sum("cu"), F.lit(0)).cast("double").alias("n"), F.count("*").alias("v"))
    # one table of pairs with all that their probability needs, so that texts are joined once for pairs that are known
    known = checkpointed(bi.join(first, "a").join(uni, "b").crossJoin(F.broadcast(total)).select("a", "b", (F.col("cb") / F.col("ca") * weight + (F.col("cu") + 1) / (F.col("n") + F.col("v") + 1) * (1 - weight)).alias("p"), "cb"))
    rows = pairs(df, id_col).groupBy(id_col, "a", "b").agg(F.count("*").alias("k"))
    head = F.broadcast(known.orderBy(F.desc("cb"), "a", "b").limit(HEAD).select("a", "b", F.col("p").alias("_p")))
    rows = rows.join(head, ["a", "b"], "left")
    rest = rows.where("_p IS NULL").drop("_p").join(known.select("a", "b", "p"), ["a", "b"], "left")
    seen = rest.where("p IS NOT NULL")
    new = _looked_up(rest.where("p IS NULL").drop("p"), uni, ["b"], "cu").crossJoin(F.broadcast(total))  # one row
    new = new.withColumn("p", (F.coalesce("cu", F.lit(0)) + 1) / (F.col("n") + F.col("v") + 1) * (1 - weight))
    scored = rows.where("_p IS NOT NULL").select(id_col, "k", F.col("_p").alias("p")).unionByName(seen.select(id_col, "k", "p")).unionByName(new.select(id_col, "k", "p"))
    lp = scored.groupBy(id_col).agg(F.sum("k").alias("t"), F.sum(F.log("p") * F.col("k")).alias("l"))
    long = F.col("_n") >= min_tokens
    return df.select(id_col, T.n_words(F.col(text_col)).alias("_n")).join(lp, id_col, "left").select(id_col, F.when(long, F.exp(-F.col("l") / F.col("t"))).alias("ppl"))
