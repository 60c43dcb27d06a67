"""Two-level keys: routing (original, routed) and translation (routed, barcode); barcodes far from each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.functions import codecs, distance, minhash
from helicase.functions import seq as q
from helicase.operators.container import Table, next_id, with_dense_ids
from helicase.tables import checkpoint


#: Bands for the search of near barcodes: two strands of distance 0.3 share none of these buckets once in a million pairs.
NEAR = minhash.Lsh(k=5, r=40, b=20)


@dataclass(frozen=True)
class Addresses:
    routing: DataFrame
    translation: DataFrame

    def route_and_translate(self, originals: DataFrame) -> DataFrame:
        """(original, routed, barcode), null where unknown. Who doesn't ask for the barcode doesn't join it."""
        return originals.select("original").join(self.routing, "original", "left").join(self.translation, "routed", "left").select("original", "routed", "barcode")

    def missing(self, originals: DataFrame) -> DataFrame:
        return originals.select("original").join(self.routing, "original", "left_anti")

    def compute(self, originals: DataFrame, size: int = 80, permutations: int = 8) -> Addresses:
        """Addresses with those that were missing: unknown ids, in order, are routed to the next free numbers, and these
        translated to their barcodes. What is known stays."""
        start = next_id(self.translation, "routed").first()[0]
        new = with_dense_ids(self.missing(originals).distinct(), ["original"], start, "routed")
        return self.put(new.withColumn("barcode", codecs.barcode("routed", size, permutations)))

    def put(self, entries: DataFrame) -> Addresses:
        """Entries (original, routed, barcode) replace those of their keys."""
        return Addresses(
            self.routing.join(entries.select("original"), "original", "left_anti").unionByName(entries.select("original", "routed")),
            self.translation.join(entries.select("routed"), "routed", "left_anti").unionByName(entries.select("routed", "barcode")),
        )

    def remove(self, originals: DataFrame) -> Addresses:
        gone = self.routing.join(originals.select("original"), "original", "left_semi")
        return Addresses(self.routing.join(gone, ["original", "routed"], "left_anti"), self.translation.join(gone.select("routed"), "routed", "left_anti"))

    def reroute(self, moves: DataFrame) -> Addresses:
        """Originals (original, routed) point elsewhere; nothing is copied."""
        return Addresses(self.routing.join(moves.select("original"), "original", "left_anti").unionByName(moves), self.translation)


def identity(originals: DataFrame) -> DataFrame:
    return originals.select("original", F.col("original").alias("routed"))


def near_pairs(strands: DataFrame, lsh: minhash.Lsh, below: float) -> DataFrame:
    """(a, b) of strands (id, seq) that share a bucket and whose k-mer distance, or distance to the complement, is below."""
    both = strands.select("id", "seq", F.lit(False).alias("turned")).unionByName(strands.select("id", q.complement("seq").alias("seq"), F.lit(True).alias("turned")))
    sig = both.select("id", "turned", F.array_sort(F.array_distinct(q.kmer_codes("seq", lsh.k))).alias("codes"))
    rows = sig.select("id", "turned", "codes", F.explode(minhash.bands(minhash.signature_of(F.col("codes"), lsh), lsh)).alias("x"))
    left = rows.where("NOT turned").select(F.col("id").alias("a"), F.col("codes").alias("ca"), "x")
    right = rows.select(F.col("id").alias("b"), F.col("codes").alias("cb"), F.col("x"))
    near = left.join(right, "x").where("a < b").where(distance.jaccard_of(F.col("ca"), F.col("cb")) < below)
    return near.select("a", "b").distinct()


def assign_barcodes(spark, count: int, size: int = 80, permutations: int = 8, lsh: minhash.Lsh = NEAR, least: float = 0.3, spare: float = 1.0) -> DataFrame:
    """(original, routed, barcode) for originals 0 .. count - 1: the first barcodes, in order of their numbers, of which
    none is nearer than ``least`` to an accepted one before it, or to its complement.

    All candidates are made at once and near pairs found by buckets. A candidate is accepted when every nearer one
    before it is rejected, and rejected when one before it is accepted; rounds of joins settle this greedy order, the
    first open candidate in each, until none is left.
    """
    total, judged = int(count * (1 + spare)) + 8, None
    while judged is None or judged.where("accepted").count() < count:
        judged, total = candidates(spark, total, size, permutations, lsh, least), 2 * total
    accepted = judged.where("accepted").select(F.col("id").alias("routed"), F.col("seq").alias("barcode"))
    return with_dense_ids(accepted, ["routed"], name="original").where(F.col("original") < count).select("original", "routed", "barcode")


def bad_count(judged: DataFrame) -> DataFrame:
    """(size, bad): candidates that were accepted and rejected."""
    return judged.agg(F.count_if("accepted").alias("size"), F.count_if(~F.col("accepted")).alias("bad"))


def candidates(spark, total: int, size: int = 80, permutations: int = 8, lsh: minhash.Lsh = NEAR, least: float = 0.3) -> DataFrame:
    """(id, seq, accepted) of the first barcodes; see ``assign_barcodes``."""
    made = checkpoint(spark.range(total).select(F.col("id"), codecs.barcode("id", size, permutations).alias("seq")))
    near = checkpoint(near_pairs(made, lsh, least))
    state = made.select("id", F.when(F.lit(True), F.lit("open")).alias("state"))
    while True:
        before = near.join(state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.col("state") == "accepted").alias("hit"), F.max(F.col("state") == "open").alias("wait"))
        settled = state.join(before, "id", "left")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("hit", F.lit(False)), "rejected").when(F.coalesce("wait", F.lit(False)), "open").otherwise("accepted")
        state = checkpoint(settled.select("id", new.alias("state")))
        if state.where("state = 'open'").isEmpty():
            return made.join(state, "id").select("id", "seq", (F.col("state") == "accepted").alias("accepted"))


@dataclass(frozen=True)
class Managed:
    """A container keyed by barcodes, seen under original ids."""

    table: Table
    addresses: Addresses

    def get(self, originals: DataFrame) -> DataFrame:
        """(original, value) for every id asked for, null where there is none."""
        asked = self.addresses.route_and_translate(originals)
        return asked.join(self.table.rows.withColumnRenamed("key", "barcode"), "barcode", "left").select("original", "value")

    def put(self, entries: DataFrame) -> Managed:
        """Entries (original, value) of ids that have an address, under their barcodes."""
        keyed = self.addresses.route_and_translate(entries).join(entries, "original").where("barcode IS NOT NULL")
        return Managed(self.table.put(keyed.select(F.col("barcode").alias("key"), "value")), self.addresses)

    def keys(self) -> DataFrame:
        known = self.addresses.routing.join(self.addresses.translation, "routed")
        return known.join(self.table.rows.select(F.col("key").alias("barcode")), "barcode", "left_semi").select("original")
