"""The least k-mer distance of probes to the entries of their buckets: blocks of probes by blocks of entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helicase.functions import seq as q
from helicase.functions.minhash import codes_of
from helicase.shipping import ship

#: Sets of up to 4**DENSE codes are bitmaps.
DENSE = 5
#: Most rows of a block, near enough: rows are dealt out by hashes.
PROBES, ENTRIES = 1 << 13, 1 << 13
#: Most numbers of a matrix.
CELLS = 1 << 21


def packed(strand: str, k: int) -> bytes:
    """A strand's k-mer set: a bitmap over all codes where these are few, else sorted codes."""
    codes = codes_of(strand, k)
    if k > DENSE:
        return codes.astype("<u4").tobytes()
    bits = np.zeros(4**k, np.uint8)
    bits[codes] = 1
    return np.packbits(bits).tobytes()


def packed_codes(seq, k: int) -> Column:
    """The column of strands' packed sets, null for null."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else packed(x, k) for x in s], index=s.index, dtype=object)

    return run(q._col(seq))


def _sizes(sets: list[bytes], k: int) -> np.ndarray:
    if k > DENSE:
        return np.array([len(x) // 4 for x in sets], np.int64)
    return np.unpackbits(np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1), axis=1).sum(axis=1, dtype=np.int64)


def _matrix(sets: list[bytes], columns: np.ndarray, k: int) -> np.ndarray:
    """A row of 0 and 1 for each set, over the codes that columns lists in order."""
    if k <= DENSE:
        return np.unpackbits(np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1), axis=1)[:, columns].astype(np.float32)
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, x in zip(out, sets, strict=True):
        codes = np.frombuffer(x, "<u4")
        row[np.searchsorted(columns, codes[np.isin(codes, columns, assume_unique=True)])] = 1
    return out


def _columns(sets: list[bytes], k: int) -> np.ndarray:
    if k > DENSE:
        return np.unique(np.frombuffer(b"".join(sets), "<u4"))
    return np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1))))


def _parts(sizes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Runs of sets whose matrix over their own codes stays within CELLS, one set at least."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if i > start and (i - start + 1) * min(total, 4**k) > CELLS:
            out.append((start, i))
            start, total = i, int(n)
    return [*out, (start, len(sizes))]


def least_of(probes: list[bytes], own: list, entries: list[bytes], low: list, high: list, k: int) -> np.ndarray:
    """The least distance of each probe's set to an entry's, without the entry whose keys, from low to high, are only
    the probe's own; nan without any."""
    n, m = _sizes(probes, k), _sizes(entries, k)
    alone: dict = {}
    for j, (x, y) in enumerate(zip(low, high, strict=True)):
        if x == y:
            alone.setdefault(x, []).append(j)
    best = np.full(len(probes), np.nan)
    for a, b in _parts(n, k):
        columns = _columns(probes[a:b], k)
        left = _matrix(probes[a:b], columns, k)
        step = max(1, CELLS // max(len(columns), b - a, 1))
        for c in range(0, len(entries), step):
            d = min(c + step, len(entries))
            both = (left @ _matrix(entries[c:d], columns, k).T).astype(np.float64)
            union = n[a:b, None] + m[None, c:d] - both
            # as 1 - both / union for doubles; two empty sets have no distance
            with np.errstate(invalid="ignore"):
                far = 1 - np.divide(both, union, out=both)
            for i in range(a, b):
                for j in alone.get(own[i], ()):
                    if c <= j < d:
                        far[i - a, j - c] = np.nan
            best[a:b] = np.fmin(best[a:b], np.fmin.reduce(far, axis=1))
    return best


def least(probes: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(probe, distance): the least distance of any row of a probe to an entry of its bucket; no row where it has none.

    probes: (band, sig, codes, probe, own), own being the one key that doesn't count, or null; entries: (band, sig, codes,
    key). Entries of a bucket with equal sets are one row. A bucket's rows meet in blocks, so that a large one is dealt
    over many tasks, and no pair is a row."""
    ship(probes)
    bucket = ["band", "sig"]
    sets = entries.where("codes IS NOT NULL").groupBy(*bucket, "codes").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    asked = probes.where("codes IS NOT NULL").join(sets.select(*bucket).distinct(), bucket, "left_semi")
    cuts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    grid = asked.groupBy(*bucket).agg(F.count("*").alias("p")).join(sets.groupBy(*bucket).agg(F.count("*").alias("e")), bucket)
    grid = grid.select(*bucket, cuts(F.col("p"), PROBES).alias("across"), cuts(F.col("e"), ENTRIES).alias("down"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    left = asked.join(grid, bucket).select(*bucket, dealt("probe", "across").alias("i"), every("down").alias("j"), "codes", "probe", "own")
    right = sets.join(grid, bucket).select(*bucket, every("across").alias("i"), dealt("codes", "down").alias("j"), "codes", "low", "high")
    schema = StructType([StructField("probe", probes.schema["probe"].dataType), StructField("distance", DoubleType())])

    def run(p: pa.Table, e: pa.Table) -> pa.Table:
        far = least_of(p["codes"].to_pylist(), p["own"].to_pylist(), e["codes"].to_pylist(), e["low"].to_pylist(), e["high"].to_pylist(), k) if len(p) and len(e) else np.full(len(p), np.nan)
        return pa.table({"probe": p["probe"], "distance": pa.array(far, pa.float64(), mask=np.isnan(far))})

    block = [*bucket, "i", "j"]
    met = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(run, schema)
    return met.groupBy("probe").agg(F.min("distance").alias("distance")).where("distance IS NOT NULL")
