"""Payloads chosen against what is stored: of several permutations the one that errs least and is farthest from the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions import codecs, kernel, minhash, rules
from helicase.functions import seq as q
from helicase.operators import nearest
from helicase.tables import checkpoint

SCORED = rules.Rules({"gc": rules.gc_error, "hp": rules.hp_error}).freeze()


def permutations(df: DataFrame, count: int) -> DataFrame:
    """(id, address, number, payload) for each of count permutations of (id, address, seq)."""
    kind = kernel.packed_type(count)
    numbers = F.array(*[F.struct(F.lit(i).alias("number"), codecs.pack(F.lit(i), kind).alias("packed")) for i in range(max(count, 1))])
    d = df.select("id", "address", "seq", q.seed("seq").alias("seed"), F.explode(numbers).alias("x"))
    return d.select("id", "address", "x.number", F.concat("x.packed", codecs.permuted("seq", F.col("seed") + F.col("x.number"))).alias("payload"))


def choose(
    df: DataFrame, index: DataFrame, stored: DataFrame, lsh: minhash.Lsh, count: int = 8, error_weight: float = 1.0, distance_weight: float = 1.0, chunk: int = 300
) -> DataFrame:
    """(id, address, payload): the permutation with the highest score of each (id, address, seq); the first of equals.

    The score of an oligo is the sum over its chunks of -error_weight * error + distance_weight * the least k-mer
    distance of the chunk or its complement to stored strands (id, seq) in the same buckets of the index, 1 without
    any. A batch is scored against the index as it stands, so that its rows are independent; insert what was chosen
    before the next batch.
    """
    made = checkpoint(permutations(df, count))  # permuted once, read three times
    parts = made.select("id", "number", F.posexplode(q.split_every(F.concat("address", "payload"), chunk)).alias("part", "s"))
    both = parts.select("id", "number", "part", F.explode(F.array("s", q.complement("s"))).alias("s"))
    signed = both.select(F.struct("id", "number", "part").alias("probe"), nearest.packed_codes("s", lsh.k).alias("codes"), minhash.signature_of_long("s", lsh).alias("sig")).where("sig IS NOT NULL")
    probes = signed.select("probe", "codes", F.lit(None).cast(index.schema["key"].dataType).alias("own"), F.explode(minhash.bands(F.col("sig"), lsh)).alias("x")).select("probe", "codes", "own", "x.band", "x.sig")
    entries = index.join(stored.select(F.col("id").alias("key"), nearest.packed_codes("seq", lsh.k).alias("codes")), "key")
    near = nearest.least(probes, entries, lsh.k).select("probe.*", F.col("distance").alias("d"))
    scored = parts.join(near, ["id", "number", "part"], "left")
    score: Column = -error_weight * SCORED.error("s") + distance_weight * F.coalesce("d", F.lit(1.0))
    total = scored.groupBy("id", "number").agg(F.sum(score).alias("score"))
    best = total.groupBy("id").agg(F.max_by("number", F.struct(F.round("score", 9), -F.col("number"))).alias("number"))
    return made.join(best, ["id", "number"]).select("id", "address", "payload")
