"""Connected components of an edge table, without holding the graph anywhere at once."""
from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A session on one
    machine that has none (as in tests) gets a folder of its own, gone when it ends; on a
    cluster a missing setting raises, as no other folder is known to be shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            master = context.master or ""
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="gristmill-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its least node.

    Alternates "every neighbour above me points to my least neighbour" with "everyone
    at or below me points to it", which reaches stars in a number of rounds that is
    logarithmic in the diameter. Both steps are a grouped minimum followed by a join on
    the same key, so that a node of very many neighbours is pre-aggregated before the
    shuffle and AQE may split it in the join; no list of neighbours is ever collected.
    Each round is cut off by a checkpoint. Null ends are dropped; a self-loop makes a
    component of one node; no edges give no rows. Raises if ``max_rounds`` don't do.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    last = None
    for _ in range(max_rounds):
        # large star: over both directions, link greater neighbours to the least of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: over edges downwards, link lesser neighbours and the node itself to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if last == (now["n"], now["s"]):
            break
        last = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
