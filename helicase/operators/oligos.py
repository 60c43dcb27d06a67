"""Strand storage: values as fixed-size oligos behind routing and translation tables.

objects (id, n_segments, length), oligos (routed, address, payload), routing (original, routed), translation
(routed, barcode). A value's first segment carries a header of 43 bases: the id of its first continuation (-1 for
none) and its number of segments less one. An oligo is a barcode address and a payload; a payload is the packed number
of a permutation and the permuted segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from helicase.functions import codecs, kernel
from helicase.functions import seq as q
from helicase.tables import checkpoint

HEADER = 43


@dataclass(frozen=True)
class Layout:
    """Sizes in bases, and the number of permutations tried; segments must hold the header."""

    address: int = 80
    payload: int = 150
    permutations: int = 8
    gc_fix: int = 10

    def __post_init__(self) -> None:
        if self.room < HEADER or self.address < 20:
            raise ValueError("segments are too short for the header, or addresses below 20 bases")

    @property
    def segment(self) -> int:
        """Bases of a padded segment."""
        return self.payload - len(kernel.pack(0, kernel.packed_type(self.permutations)))

    @property
    def room(self) -> int:
        """Bases of data in a segment."""
        return self.segment - 1 - len(kernel.SEGMENT_DELIMITER) - self.gc_fix


def _segments(n: Column, room: int) -> Column:
    return F.greatest(F.ceil((n + HEADER) / room), F.lit(1)).cast("int")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Store:
    objects: DataFrame
    oligos: DataFrame
    routing: DataFrame
    translation: DataFrame
    layout: Layout


def put(values: DataFrame, layout: Layout = Layout(), start: int = 0) -> Store:
    """A store of values (id, seq) with dense ids start, start + 1, ...; continuations get the ids after them, in order.

    Where a value's continuations begin is the sum of those before it: summed by range of ids and then within a range,
    so that no task sees all values.
    """
    per_range = 4096
    v = values.select("id", "seq", _segments(F.length("seq"), layout.room).alias("n")).withColumn("range", F.floor(F.col("id") / per_range))
    sums = v.groupBy("range").agg(F.sum(F.col("n") - 1).alias("more"), F.count("*").alias("k"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for every 4096 values
    total = W.partitionBy()
    sums = sums.select("range", F.coalesce(F.sum("more").over(before), F.lit(0)).alias("skip"), F.sum("k").over(total).alias("values"))
    inside = W.partitionBy("range").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    v = v.join(sums, "range").withColumn("next", F.lit(start) + F.col("values") + F.col("skip") + F.coalesce(F.sum(F.col("n") - 1).over(inside), F.lit(0)))
    next_id = F.when(F.col("n") > 1, F.col("next")).otherwise(F.lit(-1))
    v = v.withColumn("sized", F.concat(codecs.pack(next_id, "INT_64"), codecs.pack(F.col("n") - 1, "SHORT"), F.col("seq")))
    parts = v.select("id", "n", F.length("seq").alias("length"), "next", F.posexplode(codecs.segments("sized", layout.segment, layout.gc_fix)).alias("seg", "part"))
    parts = parts.withColumn("original", F.when(F.col("seg") == 0, F.col("id")).otherwise(F.col("next") + F.col("seg") - 1))
    # dealt out by number: segments are small rows with much work each, which adaptive execution would put together
    parts = parts.repartition(_partitions(parts), "original")
    oligos = parts.select("original", F.col("original").alias("routed"), codecs.barcode("original", layout.address, layout.permutations).alias("address"), codecs.best_permutation("part", layout.permutations).alias("payload"))
    return Store(
        objects=v.select("id", F.col("n").alias("n_segments"), F.length("seq").alias("length")),
        oligos=oligos.select("routed", "address", "payload"),
        routing=oligos.select("original", "routed"),
        translation=oligos.select("routed", F.col("address").alias("barcode")),
        layout=layout,
    )


def written(store: Store) -> Store:
    """The store with its tables written: they are made once, however often they are read."""
    return Store(*[checkpoint(getattr(store, x)) for x in ("objects", "oligos", "routing", "translation")], store.layout)


def addressed(store: Store, ids: DataFrame) -> DataFrame:
    """(id, seg, address, payload) of the objects' oligos: the first by its id, continuations by the header's range of ids."""
    keyed = store.routing.join(store.oligos, "routed")
    root = ids.select("id").join(keyed.withColumnRenamed("original", "id"), "id")
    root = root.withColumn("part", codecs.unpad(codecs.undo_permutation("payload"), kernel.SEGMENT_DELIMITER))
    header = codecs.unpack_all(F.substring("part", 1, HEADER), True)
    # tried, since a filter may run before the join, on oligos without a header
    root = root.withColumn("header", header).withColumn("n", F.try_element_at("header", F.lit(2)))
    more = root.where("n > 0").select("id", F.posexplode(F.sequence(F.try_element_at("header", F.lit(1)), F.try_element_at("header", F.lit(1)) + F.col("n") - 1)).alias("seg", "original"))
    more = more.join(keyed, "original").select("id", (F.col("seg") + 1).alias("seg"), "address", "payload")
    return root.select("id", F.lit(0).alias("seg"), "address", "payload").unionByName(more)


def assemble(oligos: DataFrame) -> DataFrame:
    """(id, seq) from (id, seg, address, payload)."""
    parts = oligos.repartition(_partitions(oligos), "id").select("id", "seg", codecs.unpad(codecs.undo_permutation("payload"), kernel.SEGMENT_DELIMITER).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("id").agg(whole.alias("sized")).select("id", F.substring("sized", F.lit(HEADER + 1), F.length("sized")).alias("seq"))


def get(store: Store, ids: DataFrame) -> DataFrame:
    """(id, seq) of every id asked for; null where there is no such object."""
    return ids.select("id").join(assemble(addressed(store, ids)), "id", "left")


def remove(store: Store, ids: DataFrame) -> Store:
    """A store without the objects and all of their segments."""
    gone = addressed(store, ids).select("address")
    routed = store.oligos.join(gone, "address", "left_semi").select("routed")
    return Store(
        store.objects.join(ids.select("id"), "id", "left_anti"),
        store.oligos.join(routed, "routed", "left_anti"),
        store.routing.join(routed, "routed", "left_anti"),
        store.translation.join(routed, "routed", "left_anti"),
        store.layout,
    )


def joined(store: Store) -> DataFrame:
    """All oligos as one strand each."""
    return store.oligos.select("routed", q.join("address", "payload").alias("oligo"))


def assemble_raw(oligos: DataFrame, layout: Layout) -> DataFrame:
    """(id, seq) from raw oligos (id, seg, oligo), cut at the address size."""
    cut = q.split_oligo("oligo", layout.address)
    return assemble(oligos.select("id", "seg", cut["address"].alias("address"), cut["payload"].alias("payload")))


def referenced(store: Store, ids: DataFrame) -> DataFrame:
    """(id, addresses, payloads, oligos, size) of the objects: their oligos as arrays in segment order; empty where absent."""
    rows = addressed(store, ids).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg", "address", "payload"))).alias("o"))
    out = ids.select("id").join(rows, "id", "left")
    of = lambda name: F.coalesce(F.transform("o", lambda x: x[name]), F.array().cast("array<string>"))
    out = out.select("id", of("address").alias("addresses"), of("payload").alias("payloads"))
    return out.withColumn("oligos", F.zip_with("addresses", "payloads", lambda a, p: F.concat(a, p))).withColumn("size", F.size("addresses"))


def append(store: Store, more: Store) -> Store:
    """Both stores' rows, where the second one's ids follow the first one's."""
    return Store(*[getattr(store, x).unionByName(getattr(more, x)) for x in ("objects", "oligos", "routing", "translation")], store.layout)
