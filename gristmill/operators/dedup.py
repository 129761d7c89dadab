"""Exact duplicates: by address and by content."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import urls as U
from gristmill.operators.components import checkpointed


def content_key(c: Column, normalize: bool = True) -> Column:
    """128 bits of the text, in lower case and with single blanks if ``normalize``; an empty text has a key like any other."""
    return F.md5(T.fingerprint_text(c) if normalize else T.text_of(c))


def representatives(df: DataFrame, key: Column, order: str, keep: str = "first") -> DataFrame:
    """``key, order, n`` of the row to keep of each key and how many there are.

    A grouped minimum or maximum, pre-aggregated before the shuffle: of a key that a third
    of all rows share no more than one row a task is moved. ``order`` must be unique.
    """
    pick = F.min(order) if keep == "first" else F.max(order)
    return df.select(key.alias("key"), order).groupBy("key").agg(pick.alias(order), F.count("*").alias("n"))


#: Ids up to this number are broadcast (some 40 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def removed(df: DataFrame, key: Column, order: str, keep: str = "first") -> DataFrame:
    """The ids of the rows that aren't kept; only keys and ids are moved. Written out, so that it is made once."""
    kept = representatives(df, key, order, keep).select(order)
    return checkpointed(df.where(F.col(order).isNotNull()).select(order).join(kept, order, "left_anti"))


def excluding(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``df`` without the rows of ``ids``; rows of a null id stay.

    The ids are counted first: few are broadcast, so that ``df`` and its texts aren't
    shuffled; beyond ``BROADCAST_IDS`` both sides are shuffled by id, which is unique.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_anti")


def keep_one(df: DataFrame, key: Column, order: str, keep: str = "first") -> DataFrame:
    """The rows of ``df`` that are kept, one of each key; see ``excluding``. Rows of a null id are no copies of others and stay."""
    return excluding(df, removed(df, key, order, keep), order)


def url_key(url: Column, text: Column) -> Column:
    """Key of the normal form of an address; a row without one goes by its content, so that such rows don't all fall together."""
    norm = U.normalized(url)
    return F.when(norm == "", F.concat(F.lit("t"), content_key(text))).otherwise(F.concat(F.lit("u"), F.md5(norm)))


def duplicate_sources(df: DataFrame, key: Column, url: Column) -> DataFrame:
    """``key, n, n_domains, kind`` of each group of more than one row; ``same_domain`` if its rows name exactly one host."""
    host = F.nullif(U.domain(url), F.lit(""))
    per = df.select(key.alias("key"), host.alias("host")).groupBy("key", "host").agg(F.count("*").alias("c"))
    groups = per.groupBy("key").agg(F.sum("c").alias("n"), F.count("host").alias("n_domains")).where("n > 1")
    return groups.withColumn("kind", F.when(F.col("n_domains") == 1, "same_domain").otherwise("cross_domain"))


def top_domains(df: DataFrame, key: Column, url: Column, k: int = 10) -> DataFrame:
    """``host, n`` of the ``k`` hosts with the most rows in groups of more than one row; ties by host."""
    host = F.nullif(U.domain(url), F.lit(""))
    per = df.select(key.alias("key"), host.alias("host")).groupBy("key", "host").agg(F.count("*").alias("c"))
    groups = per.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1").select("key")
    hosts = per.where("host IS NOT NULL").join(groups, "key", "left_semi").groupBy("host").agg(F.sum("c").alias("n"))
    return hosts.orderBy(F.desc("n"), "host").limit(k)


def first_by(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; for small tables of few rows a key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
