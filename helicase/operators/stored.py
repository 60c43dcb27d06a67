"""Arrays and lists inside the strand store.

An array is a head, whose strand has the id of the first element and their number, and its elements under the ids that
follow. A list is a chain of nodes: a pointer of 34 bases to the next node, then the element's strand; its head is a
node without an element. The last pointer names an id that nothing has yet: who appends puts a node there, and nothing
that is stored is changed. An insertion takes the place of the node at its position by routing: the old node's strands
stay as they are and get another id, to which the new node points.

What is read goes through the oligos: heads, pointers and elements are decoded from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions import codecs, kernel
from helicase.operators import oligos
from helicase.operators.collections import KEY, follow
from helicase.operators.container import with_dense_ids
from helicase.tables import checkpoint

POINTER = 34
TEXT = codecs.TWO_BIT


@dataclass(frozen=True)
class Collections:
    """A store and the heads (collection_id, head) of the collections in it."""

    store: oligos.Store
    heads: DataFrame


def _numbered(rows: DataFrame, keys: DataFrame, start: int = 0) -> DataFrame:
    """Rows (collection_id, pos, value), and one of pos -1 for each key, with dense ids in their order."""
    heads = keys.select(KEY).distinct().select(KEY, F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("value"))
    return with_dense_ids(heads.unionByName(rows.select(KEY, F.col("pos").cast("int").alias("pos"), "value")), [KEY, "pos"], start)


def _pointer(node: Column) -> Column:
    return codecs.pack(node, "INT_64")


def _reserved(node: Column) -> Column:
    """The id that a chain's last node points to: nobody else's."""
    return -2 - node


def _next_id(store: oligos.Store) -> int:
    return (store.oligos.agg(F.max("routed")).first()[0] or 0) + 1


def put_arrays(rows: DataFrame, keys: DataFrame, layout: oligos.Layout, codec: codecs.Codec = TEXT) -> Collections:
    """Arrays of rows (collection_id, pos, value), positions from 0 without gaps; empty ones for keys without rows."""
    nodes = _numbered(rows, keys)
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    head = F.concat(_pointer(F.col("id") + 1), codecs.pack(F.coalesce("n", F.lit(0)), "INT_32"))
    strands = nodes.join(sizes, KEY, "left").select("id", F.when(F.col("pos") < 0, head).otherwise(codec.encode(F.col("value"))).alias("seq"))
    return Collections(oligos.written(oligos.put(checkpoint(strands), layout)), nodes.where("pos < 0").select(KEY, F.col("id").alias("head")))


def _array_ids(kept: Collections, keys: DataFrame) -> DataFrame:
    """(collection_id, pos, id) of the elements, by what the heads say."""
    heads = keys.select(KEY).join(kept.heads, KEY)
    said = heads.join(oligos.get(kept.store, heads.select(F.col("head").alias("id"))), F.col("id") == F.col("head"))
    said = said.select(KEY, codecs.unpack_all("seq").alias("x")).select(KEY, F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("n")).where("n > 0")
    return said.select(KEY, F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos", "id"))


def get_arrays(kept: Collections, keys: DataFrame, codec: codecs.Codec = TEXT) -> DataFrame:
    """(collection_id, pos, value) of the arrays asked for."""
    ids = _array_ids(kept, keys)
    return ids.join(oligos.get(kept.store, ids.select("id")), "id").select(KEY, "pos", codec.decode(F.col("seq")).alias("value"))


def array_oligos(kept: Collections, keys: DataFrame) -> DataFrame:
    """(collection_id, id, seg, address, payload): the oligos of heads and elements."""
    ids = _array_ids(kept, keys).select(KEY, "id").unionByName(keys.select(KEY).join(kept.heads, KEY).select(KEY, F.col("head").alias("id")))
    return ids.join(oligos.addressed(kept.store, ids.select("id")), "id").select(KEY, "id", "seg", "address", "payload")


def put_lists(rows: DataFrame, keys: DataFrame, layout: oligos.Layout, codec: codecs.Codec = TEXT) -> Collections:
    """Lists of rows (collection_id, pos, value), positions from 0 without gaps; empty ones for keys without rows."""
    nodes = _numbered(rows, keys)
    sizes = rows.groupBy(KEY).agg(F.max("pos").alias("last"))
    after = F.when(F.col("pos") == F.coalesce("last", F.lit(-1)), _reserved(F.col("id"))).otherwise(F.col("id") + 1)
    strands = nodes.join(sizes, KEY, "left").select("id", F.concat(_pointer(after), F.when(F.col("pos") < 0, F.lit("")).otherwise(codec.encode(F.col("value")))).alias("seq"))
    return Collections(oligos.written(oligos.put(checkpoint(strands), layout)), nodes.where("pos < 0").select(KEY, F.col("id").alias("head")))


def _chain(kept: Collections, keys: DataFrame) -> DataFrame:
    """(collection_id, node, pos, next) of the lists asked for; heads have pos -1. Pointers lie in the values' first
    oligos, so that no others are read."""
    first = kept.store.routing.join(kept.store.objects.select(F.col("id").alias("routed")), "routed", "left_semi").join(kept.store.oligos, "routed")
    part = codecs.unpad(codecs.undo_permutation("payload"), kernel.SEGMENT_DELIMITER)
    pointers = first.select(F.col("original").alias("node"), F.substring(part, oligos.HEADER + 1, POINTER).alias("p"))
    pointers = checkpoint(pointers.select("node", F.get(codecs.unpack_all("p", True), F.lit(0)).alias("next")))
    heads = keys.select(KEY).join(kept.heads, KEY).select(KEY, F.col("head").alias("node"))
    return follow(heads, pointers).join(pointers, "node").select(KEY, "node", (F.col("pos") - 1).alias("pos"), "next")


def get_lists(kept: Collections, keys: DataFrame, codec: codecs.Codec = TEXT) -> DataFrame:
    """(collection_id, pos, value) of the lists asked for."""
    chain = _chain(kept, keys).where("pos >= 0")
    strand = F.substring(F.col("seq"), F.lit(POINTER + 1), F.length("seq"))
    return chain.join(oligos.get(kept.store, chain.select(F.col("node").alias("id"))), F.col("node") == F.col("id")).select(KEY, "pos", codec.decode(strand).alias("value"))


def list_oligos(kept: Collections, keys: DataFrame) -> DataFrame:
    """(collection_id, id, seg, address, payload): the oligos of all nodes, heads included."""
    ids = _chain(kept, keys).select(KEY, F.col("node").alias("id"))
    return ids.join(oligos.addressed(kept.store, ids.select("id")), "id").select(KEY, "id", "seg", "address", "payload")


def _with(kept: Collections, strands: DataFrame, routes: DataFrame) -> Collections:
    """With further values (id, seq), and routes (original, routed) in place of those of their originals."""
    routes = checkpoint(routes)
    store = oligos.append(kept.store, oligos.written(oligos.put(checkpoint(strands), kept.store.layout, _next_id(kept.store))))
    routing = store.routing.join(routes.select("original"), "original", "left_anti").unionByName(routes.select("original", "routed"))
    return Collections(oligos.Store(store.objects, store.oligos, checkpoint(routing), store.translation, store.layout), kept.heads)


def append(kept: Collections, more: DataFrame, codec: codecs.Codec = TEXT) -> Collections:
    """more (collection_id, ord, value) at the ends of their lists, in the order of ord."""
    start = _next_id(kept.store)
    new = with_dense_ids(more.select(KEY, "ord", "value"), [KEY, "ord"], start)
    new = checkpoint(new.join(new.groupBy(KEY).agg(F.max("id").alias("last"), F.min("id").alias("first")), KEY))
    after = F.when(F.col("id") == F.col("last"), _reserved(F.col("id"))).otherwise(F.col("id") + 1)
    strands = new.select("id", F.concat(_pointer(after), codec.encode(F.col("value"))).alias("seq"))
    chain = _chain(kept, new.select(KEY).distinct())
    ends = chain.groupBy(KEY).agg(F.max_by("next", "pos").alias("free"))
    routes = new.where("id = first").join(ends, KEY).select(F.col("free").alias("original"), F.col("id").alias("routed"))
    return _with(kept, strands, routes)


def insert(kept: Collections, at: int, values: DataFrame, codec: codecs.Codec = TEXT) -> Collections:
    """values (collection_id, value), one a list, at a position, or at the end of shorter lists."""
    if at < 0:
        raise ValueError("a position below 0")
    start = _next_id(kept.store)
    new = with_dense_ids(values.select(KEY, "value"), [KEY], start)
    chain = _chain(kept, new.select(KEY))
    # the id that the node before points to: of the node there, or the one that is still free
    spot = chain.where(F.col("pos") < at).groupBy(KEY).agg(F.max_by("next", "pos").alias("spot"))
    old = kept.store.routing.select(F.col("original").alias("spot"), F.col("routed").alias("there"))
    new = checkpoint(new.join(spot, KEY).join(old, "spot", "left"))
    moved = _reserved(F.col("id"))  # the old node's further id, or the new end's free one
    strands = new.select("id", F.concat(_pointer(moved), codec.encode(F.col("value"))).alias("seq"))
    routes = new.select(F.col("spot").alias("original"), F.col("id").alias("routed")).unionByName(new.where("there IS NOT NULL").select(moved.alias("original"), F.col("there").alias("routed")))
    return _with(kept, strands, routes)
