"""Connected components as DataFrames, and the one way this package cuts lineage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are the driver, gets a folder of its own; on a cluster that fails,
    as rows written to each executor's own disk would be lost without a word.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``edges`` (a, b of one ordered type) as (node, root): every node of an edge and the smallest of its component.

    Alternating large and small stars: neighbours are handed to the smallest node known, so the rounds grow with the
    logarithm of the longest chain, and no group of neighbours is ever gathered in one place. ``store`` keeps the edges of
    each round, so a lost executor costs a round at most; the rounds end when one changes nothing.
    """
    edges = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = tuple(edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).head())
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = store(handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
