"""Connected components of a table of links, by labels that only ever get smaller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldscope.session import scratch_path


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (a, b).

    Each round takes the smallest label among neighbours and then the label of that
    label, so paths shorten fast. Labels are written to the shared folder each round,
    which keeps plans short and survives lost executors; nothing but the number of
    changes comes to the driver.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "components")
    both = links.where("a is not null and b is not null and a <> b")
    both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct().write.parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    first.select("node", F.least("node", "low").alias("label")).write.parquet(f"{path}/0")
    turn = 0
    while True:
        now = spark.read.parquet(f"{path}/{turn}")
        near = (edges.join(now, edges["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near")))
        hooked = now.join(near, now["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        over = now.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        jumped = hooked.join(over, F.col("next") == F.col("at"), "left").select(
            "node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("changed"))
        turn += 1
        jumped.write.parquet(f"{path}/{turn}")
        done = spark.read.parquet(f"{path}/{turn}")
        if not done.where("changed").limit(1).count():
            return done.select("node", "label")
