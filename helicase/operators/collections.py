"""Arrays and lists of values as rows (collection_id, pos, value); a list's physical form is a chain of next ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from helicase.tables import checkpoint

KEY = "collection_id"


def put_array(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows (collection_id, pos, value), positions by the order."""
    return df.select(F.col(key).alias(KEY), (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).alias("pos"), F.col(value).alias("value"))


def get(rows: DataFrame, i: int) -> DataFrame:
    return rows.where(F.col("pos") == i)


def length(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg((F.max("pos") + 1).alias("length"))


def slice_(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Positions start to before end."""
    return rows.where((F.col("pos") >= start) & (F.col("pos") < end))


def reversed_slice(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Positions start down to above end, with the rank in that order."""
    part = rows.where((F.col("pos") <= start) & (F.col("pos") > end))
    return part.withColumn("rank", F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("pos"))))


def decoded(rows: DataFrame) -> DataFrame:
    """Each collection as one array."""
    return rows.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("items"))


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    """more (collection_id, ord, value) after the last position of its collection."""
    ends = rows.groupBy(KEY).agg(F.max("pos").alias("last"))
    new = more.join(ends, KEY, "left").select(KEY, (F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy(KEY).orderBy("ord"))).cast("int").alias("pos"), "value")
    return rows.unionByName(new)


def insert(rows: DataFrame, at: int, values: DataFrame) -> DataFrame:
    """values (collection_id, value) at a position, or at the end of shorter collections."""
    if at < 0:
        raise ValueError("a position below 0")
    placed = values.join(length(rows), KEY, "left").select(KEY, F.least(F.lit(at), F.coalesce("length", F.lit(0))).cast("int").alias("pos"), "value")
    moved = rows.join(placed.select(KEY, F.col("pos").alias("p")), KEY, "left").select(KEY, F.when(F.col("pos") >= F.col("p"), F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), "value")
    return moved.unionByName(placed)


def chained(rows: DataFrame, node: str) -> DataFrame:
    """The physical form (collection_id, node, next, head, value): each node with the next one's id, null at the end."""
    w = W.partitionBy(KEY).orderBy("pos")
    return rows.select(KEY, F.col(node).alias("node"), F.lead(node).over(w).alias("next"), (F.col("pos") == 0).alias("head"), "value")


def follow(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(collection_id, node, pos) of the nodes (node, next) that chains reach from their heads (collection_id, node), at
    any length: pointers double each round, and what is reached so far reaches as many nodes again. Pointers to nodes
    that aren't there end a chain; chains that lead back into themselves are an error."""
    there = nodes.select(F.col("node").alias("next"))
    jumps = checkpoint(nodes.select("node", "next").join(there, "next", "left_semi"))
    reached = checkpoint(heads.select(KEY, "node").join(nodes.select("node"), "node", "left_semi").select(KEY, "node", F.lit(0).alias("pos")))
    count, step = reached.count(), 1
    while True:
        more = reached.join(jumps, "node").select(KEY, F.col("next").alias("node"), (F.col("pos") + step).alias("pos"))
        reached = checkpoint(reached.unionByName(more))
        now = reached.count()
        if now == count:
            return reached
        if not reached.groupBy(KEY, "node").count().where("count > 1").isEmpty():
            raise ValueError("a chain leads back into itself")
        far = jumps.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = checkpoint(jumps.join(far, "next").select("node", F.col("far").alias("next")))
        count, step = now, 2 * step


def walk(nodes: DataFrame) -> DataFrame:
    """(collection_id, pos, value) by following the chain from its head; see ``follow``."""
    own = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(KEY).alias("c"), F.col(x).alias("n")))
    named = nodes.select(KEY, own("node").alias("node"), own("next").alias("next"), "head", "value")
    return follow(named.where("head"), named).join(named.select("node", "value"), "node").select(KEY, "pos", "value")


def absent(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys (collection_id) without a collection."""
    return keys.select(KEY).join(rows.select(KEY), KEY, "left_anti")
