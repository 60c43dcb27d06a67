"""Key-value tables: put, get, remove and scans as joins, on immutable DataFrames; dense ids; coded views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from helicase.tables import checkpoint


def with_dense_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """df with ids start, start + 1, ... in the order. Rows are sorted by range, and each partition numbers its own from
    where the partitions before it end, so no task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, since ranges come from samples: each row keeps its partition and place when parts are made again
    placed = checkpoint(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    return placed.join(counts, "__part").select(*[F.col(f"`{x}`") for x in df.columns], (F.col("__at") + F.col("__skip") + start).alias(name))


def next_id(rows: DataFrame, key: str = "key") -> DataFrame:
    """(next): the id after the last one, 0 for an empty table."""
    return rows.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("next"))


def reserve(rows: DataFrame, count: int, key: str = "key") -> DataFrame:
    """(id): so many ids after the last one, in order, for rows to come."""
    return next_id(rows, key).select(F.explode(F.sequence(F.col("next"), F.col("next") + count - 1)).alias("id"))


def by_every_id(rows: DataFrame) -> DataFrame:
    """(id, value) of every id below the next one, null where there is none."""
    end = next_id(rows).first()[0]
    return rows.sparkSession.range(end).join(rows.withColumnRenamed("key", "id"), "id", "left")


@dataclass(frozen=True)
class Table:
    """A container: rows (key, value), keys unique. Each operation gives a new table."""

    rows: DataFrame

    def put(self, entries: DataFrame) -> Table:
        """Upsert: entries replace rows of their key. Of entries with one key the greatest stays."""
        rest = [x for x in self.rows.columns if x != "key"]
        once = entries.groupBy("key").agg(F.max(F.struct(*rest)).alias("__e")).select("key", *[F.col("__e")[x].alias(x) for x in rest])
        return Table(self.rows.join(once.select("key"), "key", "left_anti").unionByName(once.select(*self.rows.columns)))

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) for every key asked for, null where there is none."""
        return keys.select("key").join(self.rows, "key", "left")

    def get_one(self, key) -> DataFrame:
        return self.rows.where(F.col("key") == F.lit(key))

    def remove(self, keys: DataFrame) -> Table:
        return Table(self.rows.join(keys.select("key"), "key", "left_anti"))

    def removed(self, keys: DataFrame) -> DataFrame:
        """(key, removed): whether a key asked to go is there."""
        return keys.select("key").join(self.rows.select("key", F.lit(True).alias("removed")), "key", "left").select("key", F.coalesce("removed", F.lit(False)).alias("removed"))

    def contains(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").join(self.rows.select("key"), "key", "left_semi")

    def size(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("size"))

    def keys(self) -> DataFrame:
        return self.rows.select("key")

    def values(self) -> DataFrame:
        return self.rows.select("value")

    def mapped(self, encode: Callable, decode: Callable) -> Mapped:
        return Mapped(self, encode, decode)

    def discard(self) -> Table:
        """The table that keeps nothing."""
        return Table(self.rows.limit(0))


@dataclass(frozen=True)
class Mapped:
    """A view of a table through a codec: encodes what is put, decodes what is read."""

    inner: Table
    encode: Callable
    decode: Callable

    def put(self, entries: DataFrame) -> Mapped:
        return Mapped(self.inner.put(entries.withColumn("value", self.encode(F.col("value")))), self.encode, self.decode)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.inner.get(keys).withColumn("value", self.decode(F.col("value")))

    @property
    def rows(self) -> DataFrame:
        return self.inner.rows.withColumn("value", self.decode(F.col("value")))
