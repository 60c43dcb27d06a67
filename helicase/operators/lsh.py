"""The similarity index: rows (band, sig, key), probed by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions import distance, minhash
from helicase.functions import seq as q
from helicase.operators import nearest, pairs


def insert(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(more)


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("key"), "key", "left_anti")


def light(index: DataFrame) -> DataFrame:
    """Only the buckets, without who is in them."""
    return index.select("band", "sig").distinct()


#: Most probes and entries that meet in one place, near enough: rows are dealt out by hashes.
PROBES, ENTRIES = 1 << 13, 1 << 10


def classes(index: DataFrame, name: str = "key") -> DataFrame:
    """(name, buckets): each entry with all its buckets; entries that share all of them are one class."""
    return index.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("band", "sig"))).alias("buckets")).withColumnRenamed("key", name)


def candidates(index: DataFrame, probes: DataFrame, band: int | None = None) -> DataFrame:
    """(probe, key), each once, of entries that share a bucket with a probe (as index rows). Buckets are compared for
    classes; entries then meet lists of probes, so that no pair is shuffled or sorted. Entries and lists of a class meet in
    blocks, so that a large one is dealt over many tasks, and an entry meets a bounded number of probes at a time."""
    if band is not None:
        index, probes = index.where(F.col("band") == band), probes.where(F.col("band") == band)
    keys, asked = classes(index), classes(probes, "probe").withColumnRenamed("buckets", "asked")
    cuts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *x: F.pmod(F.xxhash64(*x), F.col(n)).cast("int")
    entries, asking = keys.groupBy("buckets").agg(F.count("*").alias("e")), asked.groupBy("asked").agg(F.count("*").alias("p"))
    met = asking.select("asked", "p", F.explode("asked").alias("bucket")).join(entries.select("buckets", "e", F.explode("buckets").alias("bucket")), "bucket").select("asked", "p", "buckets", "e").distinct()
    grid = met.groupBy("buckets").agg(cuts(F.sum("p"), PROBES).alias("across"), cuts(F.first("e"), ENTRIES).alias("down"))
    lists = asked.join(asking.select("asked", cuts(F.col("p"), PROBES).alias("cuts")), "asked").groupBy("asked", dealt("cuts", "probe").alias("cut")).agg(F.collect_list("probe").alias("probes"))
    left = keys.join(grid, "buckets").select("key", "buckets", every("across").alias("i"), dealt("down", "key").alias("j"))
    right = met.select("asked", "buckets").join(grid, "buckets").join(lists, "asked").select("buckets", dealt("across", "asked", "cut").alias("i"), every("down").alias("j"), "probes")
    # a number of partitions that stays: by their bytes, small rows of many pairs would be put together
    spark, block = index.sparkSession, ["buckets", "i", "j"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return left.repartition(n, *block).join(right.repartition(n, *block), block).select(F.explode("probes").alias("probe"), "key")


def query(index: DataFrame, probes: DataFrame, every: bool = False) -> DataFrame:
    """(probe, found): whether any band, or every band, of a probe has its bucket in the index."""
    p = probes.select("band", "sig", F.col("key").alias("probe"))
    hit = p.join(light(index).withColumn("hit", F.lit(True)), ["band", "sig"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return hit.groupBy("probe").agg((F.bool_and("hit") if every else F.bool_or("hit")).alias("found"))


def query_exact(index: DataFrame, strands: DataFrame, probes: DataFrame, lsh: minhash.Lsh) -> DataFrame:
    """(probe, found): whether an equal strand is among the probe's candidates. strands and probes: (id, seq). Entries
    with one strand in one bucket are one row."""
    there = index.join(strands.select(F.col("id").alias("key"), "seq"), "key").select("seq", "band", "sig").distinct()
    asked = minhash.index(probes, "id", "seq", lsh).withColumnRenamed("key", "probe").join(probes.select(F.col("id").alias("probe"), "seq"), "probe")
    same = asked.join(there, ["seq", "band", "sig"], "left_semi").select("probe", F.lit(True).alias("found")).distinct()
    return probes.select(F.col("id").alias("probe")).join(same, "probe", "left").select("probe", F.coalesce("found", F.lit(False)).alias("found"))


def least_distance(index: DataFrame, strands: DataFrame, probes: DataFrame, lsh: minhash.Lsh, exclusive: bool = True, keep: Column | None = None, among: Column | None = None) -> DataFrame:
    """(probe, distance): the least k-mer distance to a candidate, 1 without any; exclusive: not to the strand of its own
    id; keep: only to candidates for which this condition on probe and key holds; among: the same for one on key alone,
    which costs nothing for a pair."""
    index = index.where(among) if among is not None else index
    if keep is not None:
        found = candidates(index, minhash.index(probes, "id", "seq", lsh)).where(keep)
        found = found.where("probe <> key") if exclusive else found
        k = lsh.k
        near = found.join(strands.select(F.col("id").alias("key"), q.kmer_codes("seq", k).alias("ck")), "key").join(probes.select(F.col("id").alias("probe"), q.kmer_codes("seq", k).alias("cp")), "probe")
        best = near.groupBy("probe").agg(F.min(distance.jaccard_of(F.col("ck"), F.col("cp"))).alias("distance"))
    else:
        own = F.col("id") if exclusive else F.lit(None)
        asked = minhash.index(probes, "id", "seq", lsh).withColumnRenamed("key", "id").join(probes.select("id", nearest.packed_codes("seq", lsh.k).alias("codes")), "id")
        keys = index.join(strands.select(F.col("id").alias("key"), nearest.packed_codes("seq", lsh.k).alias("codes")), "key")
        best = nearest.least(asked.select("band", "sig", "codes", F.struct("id").alias("probe"), own.cast(keys.schema["key"].dataType).alias("own")), keys, lsh.k).select("probe.id", "distance").withColumnRenamed("id", "probe")
    return probes.select(F.col("id").alias("probe")).join(best, "probe", "left").select("probe", F.coalesce("distance", F.lit(1.0)).alias("distance"))


def distances(candidates_: DataFrame, strands: DataFrame, k: int) -> DataFrame:
    """(probe, key, distance) of candidate pairs (probe, key) by the k-mers of long strands (id, seq). An entry's strand
    goes to the blocks of its probes once for each block, at two bits a base, whatever the number of its pairs."""
    return pairs.distances(candidates_, strands, k)


def near(strands: DataFrame, asked: Column, lsh: minhash.Lsh) -> DataFrame:
    """(probe, key, distance) by k-mers of each of the long strands (id, seq) for which asked holds, a condition on id, to
    each of its candidates but itself: ``candidates`` and ``distances`` in one, without a table of pairs. seq may be
    binary: the bytes whose bases ``encode_2bit`` writes."""
    return pairs.near(strands, asked, lsh)


def bloom_store(index: DataFrame, lsh: minhash.Lsh, bloom: minhash.Bloom) -> DataFrame:
    """(band, bit): a Bloom filter for each band, of the buckets that have entries. Nothing can be removed from it."""
    return light(index).select("band", F.explode(bloom.positions(minhash.band_key(F.col("sig"), lsh))).alias("bit")).distinct()


def bloom_hits(store: DataFrame, probes: DataFrame, lsh: minhash.Lsh, bloom: minhash.Bloom) -> DataFrame:
    """(probe, hits): for each band, whether a probe may have its buckets in the filters, which are asked for each bucket
    once."""
    p = probes.select(F.col("key").alias("probe"), "band", "sig")
    asked = light(probes).select("band", "sig", F.explode(bloom.positions(minhash.band_key(F.col("sig"), lsh))).alias("bit"))
    hit = asked.join(store.withColumn("set", F.lit(1)), ["band", "bit"], "left").groupBy("band", "sig").agg((F.count("set") == F.count("*")).alias("hit"))
    of = lambda i: F.bool_and(F.when(F.col("band") == i, F.col("hit")))
    return p.join(hit, ["band", "sig"]).groupBy("probe").agg(F.array(*[of(i) for i in range(lsh.b)]).alias("hits"))


def hits_of(hits: DataFrame, lsh: minhash.Lsh, every: bool = False) -> DataFrame:
    """(probe, found) of (probe, hits): whether any band, or every band, has a hit for all rows of a probe."""
    bands = [F.bool_and(F.col("hits")[i]) for i in range(lsh.b)]
    return hits.groupBy("probe").agg((F.forall if every else F.exists)(F.array(*bands), lambda x: x).alias("found"))


def bloom_query(store: DataFrame, probes: DataFrame, lsh: minhash.Lsh, bloom: minhash.Bloom, every: bool = False) -> DataFrame:
    """(probe, found): whether any band, or every band, of a probe may have its bucket in the filters."""
    return hits_of(bloom_hits(store, probes, lsh, bloom), lsh, every)
