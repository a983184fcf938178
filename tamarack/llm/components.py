"""Connected components of a table of links, by a contraction, smallest labels and pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tamarack.llm.common import materialize, remove_folder, shared_folder


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for each node of the links ``(a, b)``: the smallest node that it reaches.

    Links are contracted first: each end becomes the smallest of itself and its neighbours.  Links within one node go and
    equal ones become one, so those of a dense group, as many as the square of its nodes, are read once and not in every
    round.  Each round takes the smallest label among the neighbours and then the label of that label, so long chains
    shrink by halves.  Minima are pre-aggregated before the shuffle.  The tables of the rounds are files of the shared
    folder: of a checkpoint Spark keeps the size that it had guessed, and that of a join is the product of its sides',
    which after some rounds takes minutes to multiply.
    """
    spark, folder = links.sparkSession, f"{shared_folder(links.sparkSession)}/components-{uuid.uuid4().hex}"

    def stored(d: DataFrame, name: str) -> DataFrame:
        d.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def both_ways(d: DataFrame) -> DataFrame:
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # one pass over the links, where a union makes two
        return d.select(ways.alias("way")).select("way.a", "way.b")

    def smallest(d: DataFrame) -> DataFrame:
        return d.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))

    one_way = lambda d: d.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = stored(one_way(links), "links")
    first = stored(smallest(both_ways(once)), "first")
    for end in ("a", "b"):
        once = once.join(first.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
    both = stored(both_ways(one_way(once)), "contracted")
    labels, number = stored(smallest(both), "0"), 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        number += 1
        new = stored(new.join(jump, F.col("label") == F.col("to"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{number}")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            break
    # a node of the contracted links that has none left is a component's only one
    further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
    found = materialize(first.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
    remove_folder(spark, folder)
    return found
