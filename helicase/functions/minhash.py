"""MinHash signatures of k-mer sets, bands, and Bloom filters, as Catalyst expressions with fixed seeds."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions import seq as q


#: Digits of k-mer ranks by base.
DIGIT = np.zeros(256, np.int64)
DIGIT[[ord(b) for b in q.BASES]] = range(4)
#: Bases that are hashed at a time.
GROUP = 1 << 19
#: Codes of one strand that are hashed at a time.
CODES = 1 << 11


@lru_cache
def next_prime(n: int) -> int:
    """The smallest odd prime from n on."""
    n |= 1
    while any(n % r == 0 for r in range(3, math.isqrt(n) + 2, 2)):
        n += 2
    return n


@dataclass(frozen=True)
class Lsh:
    """r hash functions ((a x + b) mod p) mod 4**k over k-mer codes, in b bands."""

    k: int = 5
    r: int = 5
    b: int = 1
    seed: int = 7

    def __post_init__(self) -> None:
        if self.r % self.b or not 1 <= self.k <= 15:
            raise ValueError("r must be a multiple of b, and k in 1..15, whose hashes fit a long")

    @property
    def m(self) -> int:
        return 4**self.k

    @property
    def p(self) -> int:
        return next_prime(self.m)

    @property
    def functions(self) -> list[tuple[int, int]]:
        rnd = random.Random(self.seed)
        return [(rnd.randrange(1, self.p), rnd.randrange(self.p)) for _ in range(self.r)]


def signature(seq, lsh: Lsh) -> Column:
    """The r minima; null for a strand without k-mers."""
    codes = F.array_distinct(q.kmer_codes(seq, lsh.k))
    return signature_of(codes, lsh)


def signature_of(codes: Column, lsh: Lsh) -> Column:
    functions = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in lsh.functions])
    minima = F.transform(functions, lambda f: F.array_min(F.transform(codes, lambda x: F.pmod(F.pmod(f["a"] * x + f["b"], F.lit(lsh.p)), F.lit(lsh.m)))))
    return F.when(F.size(codes) > 0, minima)


def ranks_of(strand: str, k: int) -> np.ndarray:
    """Ranks of a strand's k-mers in order."""
    digits = DIGIT[np.frombuffer(strand.encode(), np.uint8)]
    n = len(digits) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = digits[:n].copy()
    for j in range(1, k):
        out += digits[j : n + j] << 2 * j
    return out


def codes_of(strand: str, k: int) -> np.ndarray:
    """Ranks of a strand's k-mers, each once, sorted."""
    return np.unique(ranks_of(strand, k))


def hashes(codes: np.ndarray, lsh: Lsh) -> np.ndarray:
    """A row of codes' hashes for each function."""
    a, b = (np.array(x, np.int64)[:, None] for x in zip(*lsh.functions, strict=True))
    if lsh.p * lsh.m >= 1 << 53:
        return (codes.astype(np.int64) * a + b) % lsh.p % lsh.m
    h = codes.astype(np.float64) * a + b  # whole numbers that doubles hold
    quotient = h * ((1 - 2**-48) / lsh.p)  # right, or one too low
    h -= np.multiply(np.floor(quotient, out=quotient), lsh.p, out=quotient)
    h = h.astype(np.int32).view(np.uint32)
    return np.minimum(h, h - np.uint32(lsh.p)) & np.uint32(lsh.m - 1)


def least(codes: np.ndarray, lsh: Lsh) -> np.ndarray:
    """The r minima of distinct codes, of which there is one at least."""
    return np.min([hashes(codes[i : i + CODES], lsh).min(axis=1) for i in range(0, len(codes), CODES)], axis=0)


def minima(strands: Sequence[str | None], lsh: Lsh) -> list[np.ndarray | None]:
    """The r minima of each strand's k-mers; None without any. Strands are hashed together, about GROUP bases at a time."""
    out: list[np.ndarray | None] = [None] * len(strands)
    held, bases = [], 0
    for i, s in enumerate(strands):
        if s is not None and len(s) >= lsh.k:
            held.append(i)
            bases += len(s)
        if held and (bases >= GROUP or i + 1 == len(strands)):
            _minima_of(strands, held, lsh, out)
            held, bases = [], 0
    return out


def _minima_of(strands: Sequence[str | None], held: list[int], lsh: Lsh, out: list) -> None:
    ranks = ranks_of("".join([strands[i] for i in held]), lsh.k)
    sizes = np.array([len(strands[i]) for i in held])
    starts = np.cumsum(sizes) - sizes
    # from each strand's first k-mer to the one after its last; those between reach into the next strand
    edges = np.column_stack((starts, starts + sizes - lsh.k + 1)).ravel()
    best = np.empty((len(held), lsh.r), np.int64)
    every = np.arange(lsh.m) if lsh.m <= len(ranks) else ranks
    hashes = np.empty(len(ranks) + 1, np.int64)
    for f, (a, b) in enumerate(lsh.functions):
        h = (a * every + b) % lsh.p % lsh.m
        hashes[:-1] = h[ranks] if every is not ranks else h
        hashes[-1] = lsh.m
        best[:, f] = np.minimum.reduceat(hashes, edges)[::2]
    for i, row in zip(held, best, strict=True):
        out[i] = row


def signature_of_long(seq, lsh: Lsh) -> Column:
    """The same as ``signature``, a batch of strands at a time, in arrays of numbers."""

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(minima(s.tolist(), lsh), index=s.index, dtype=object)

    return run(q._col(seq))


def bands(sig: Column, lsh: Lsh) -> Column:
    size = lsh.r // lsh.b
    return F.transform(F.sequence(F.lit(0), F.lit(lsh.b - 1)), lambda i: F.struct(i.alias("band"), F.slice(sig, i * size + 1, size).alias("sig")))


def index(df: DataFrame, key: str, seq: str, lsh: Lsh) -> DataFrame:
    """(band, sig, key): a row for each band of each strand with k-mers."""
    d = df.where(F.length(seq) >= lsh.k).select(F.col(key).alias("key"), signature_of_long(seq, lsh).alias("s"))
    return d.select("key", F.explode(bands(F.col("s"), lsh)).alias("x")).select("x.band", "x.sig", "key")


@lru_cache
def bloom_bits(fpp: float, n: int) -> int:
    return math.ceil(-n * math.log(fpp) / math.log(2) ** 2)


def bloom_bits_column(n, fpp: float) -> Column:
    return F.ceil(-q._col(n) * F.log(F.lit(fpp)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))


def bloom_fpp_column(hashes: int, bits, n) -> Column:
    """The share of false positives after n values."""
    return F.pow(1 - F.exp(-hashes * q._col(n) / q._col(bits)), F.lit(hashes))


def band_key(sig: Column, lsh: Lsh) -> Column:
    """A band's signature as one number: its digits in base m, where they fit a long, else a hash."""
    if lsh.r // lsh.b * 2 * lsh.k > 62:
        return F.xxhash64(sig).bitwiseAND(F.lit((1 << 62) - 1))
    return F.aggregate(sig, F.lit(0).cast("long"), lambda a, x: a * lsh.m + x)


def bloom_hashes(bits: int, n: int) -> int:
    return max(1, round(bits / n * math.log(2)))


def bloom_fpp(hashes: int, bits: int, n: int) -> float:
    return (1 - math.exp(-hashes * n / bits)) ** hashes


@dataclass(frozen=True)
class Bloom:
    """(a * low + c * high + b) mod bits over longs from 0 on, low being a value's last 31 bits; seeded a, b and c."""

    bits: int
    hashes: int
    seed: int = 7

    def positions(self, x) -> Column:
        v = q._col(x).cast("long")
        low, high = v.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright(v, 31)
        return F.array(*[F.pmod(low * a + high * c + b, F.lit(self.bits)) for a, b, c in self.functions])

    @property
    def functions(self) -> list[tuple[int, int, int]]:
        rnd = random.Random(self.seed)
        return [(rnd.randrange(1, 1 << 31), rnd.randrange(1 << 31), rnd.randrange(1 << 28)) for _ in range(self.hashes)]

    @classmethod
    def sized(cls, n: int, fpp: float, seed: int = 7) -> Bloom:
        """For n values and a share of false positives."""
        bits = bloom_bits(fpp, max(1, n))
        return cls(bits, bloom_hashes(bits, max(1, n)), seed)

    def build(self, df: DataFrame, x: str) -> DataFrame:
        """The filter as (bit), each set bit once."""
        return df.select(F.explode(self.positions(x)).alias("bit")).distinct()

    def might_contain(self, df: DataFrame, x: str, filter_: DataFrame, key: str) -> DataFrame:
        """(key, maybe): whether all bits of a row's value are set. A join on bits, so the filter may be of any size."""
        asked = df.select(F.col(key), F.explode(self.positions(x)).alias("bit"))
        found = asked.join(filter_.withColumn("set", F.lit(1)), "bit", "left")
        return found.groupBy(key).agg((F.count("set") == F.count("*")).alias("maybe"))


def bitmap(df: DataFrame, x: str) -> DataFrame:
    """(bucket, bits): whole numbers from 1 on as bitmaps of 32768 bits, a row for each bucket that has any."""
    return df.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
