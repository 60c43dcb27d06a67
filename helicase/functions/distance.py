"""Distances between base strings, as Catalyst expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from helicase.functions import seq as q
from helicase.functions.minhash import codes_of


def hamming(a, b) -> Column:
    """Mismatches plus the difference in length, over the greater length; null for two empty strands."""
    x, y = q._col(a), q._col(b)
    n = F.least(F.length(x), F.length(y))
    cut = lambda s: F.split(F.substring(s, F.lit(1), n), "")
    unequal = F.aggregate(F.zip_with(cut(x), cut(y), lambda p, r: F.when(p == r, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest > 0, (F.abs(F.length(x) - F.length(y)) + F.when(n > 0, unequal).otherwise(0)) / longest)


def edit_count(a, b) -> Column:
    return F.levenshtein(q._col(a), q._col(b))


def edit_within(a, b, limit: int) -> Column:
    """Levenshtein distance up to a limit, where counting stops; -1 beyond."""
    return F.levenshtein(q._col(a), q._col(b), limit)


def edit(a, b) -> Column:
    """Levenshtein distance over the greater length; null for two empty strands."""
    longest = F.greatest(F.length(q._col(a)), F.length(q._col(b)))
    return F.when(longest > 0, edit_count(a, b) / longest)


def jaccard(a, b, k: int) -> Column:
    """1 - |intersection| / |union| of the k-mer sets; null without k-mers."""
    x, y = q.kmers(a, k), q.kmers(b, k)
    return jaccard_of(x, y)


def jaccard_of_long(a, b, k: int) -> Column:
    """The same as ``jaccard``, for strands of thousands of bases."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return None
            u, v = codes_of(s, k), codes_of(t, k)
            both = len(np.intersect1d(u, v, assume_unique=True))
            union = len(u) + len(v) - both
            return 1 - both / union if union else None

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="Float64")

    return run(q._col(a), q._col(b))


def jaccard_of(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, 1 - F.size(F.array_intersect(x, y)) / union)


def weighted_jaccard(a, b, k: int) -> Column:
    """1 - sum of least over sum of greatest k-mer counts. Counts are runs of the sorted k-mers of both."""
    tag = lambda s, side: F.transform(q.kmers(s, k), lambda m: F.struct(m.alias("m"), F.lit(side).alias("side")))
    both = F.sort_array(F.concat(tag(a, 0), tag(b, 1)))
    start = F.struct(F.lit("").alias("m"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("low"), F.lit(0).alias("high"))

    def closed(s):
        return s["low"] + F.least(s["x"], s["y"]), s["high"] + F.greatest(s["x"], s["y"])

    def step(s, e):
        same = s["m"] == e["m"]
        low, high = closed(s)
        one = lambda v: F.when(e["side"] == v, 1).otherwise(0)
        return F.struct(
            e["m"].alias("m"),
            (F.when(same, s["x"]).otherwise(0) + one(0)).alias("x"),
            (F.when(same, s["y"]).otherwise(0) + one(1)).alias("y"),
            F.when(same, s["low"]).otherwise(low).alias("low"),
            F.when(same, s["high"]).otherwise(high).alias("high"),
        )

    def finish(s):
        low, high = closed(s)
        return F.when(high > 0, 1 - low / high)

    return F.aggregate(both, start, step, finish)


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common substring: one row of run lengths a base of a."""
    if not a or not b:
        return 0
    other = np.frombuffer(b.encode(), np.uint8)
    run, best = np.zeros(len(b) + 1, np.int32), 0
    for ch in a.encode():
        run[1:] = np.where(other == ch, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common substring."""
    return pd.Series([None if x is None or y is None else _longest_common(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
