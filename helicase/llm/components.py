"""Connected components in rounds of joins: labels shrink along links and are followed to their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.llm import _common as c


def connect(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (key, label) with labels merged over links (a, b): each component's label is the smallest of its labels.

    Works on labels, not nodes: links become links between labels, and each round gives a label the smallest label
    among its neighbours' and then that label's own (pointer jumping), until nothing changes. Sums and minima are
    aggregated before any shuffle, so that a label with very many links is one row per task.
    """
    la = nodes.select(F.col("key").alias("a"), F.col("label").alias("u"))
    lb = nodes.select(F.col("key").alias("b"), F.col("label").alias("v"))
    edges = links.join(la, "a").join(lb, "b").where("u <> v").select("u", "v")
    edges = c.checkpoint(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = c.checkpoint(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        near = edges.join(state.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        step = state.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = state.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        step = c.checkpoint(step.join(jump, "l", "left").select("u", "was", F.least("l", "ll").alias("l")))
        moved = not step.where("was <> l").isEmpty()
        state = step.select("u", "l")
        if not moved:
            break
    named = nodes.join(state.withColumnRenamed("u", "label"), "label", "left")
    return c.checkpoint(named.select("key", F.coalesce("l", "label").alias("label")))
