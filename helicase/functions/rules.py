"""Constraint rules on strands: error scores as Catalyst expressions, a registry, and their normalised sum."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions import seq as q

MAX_RUN = 6
DIMERS = ["".join(p) for p in product(q.TRANSPORT, repeat=2)]
TRIMERS = ["".join(p) for p in product(q.TRANSPORT, repeat=3)]


def gc_error(seq) -> Column:
    """By the distance of the GC content from one half: 0 to 0.1, 0.4 to 0.15, 0.8 to 0.2, else 1. Exactly 60 % counts as beyond 0.1."""
    n, g = F.length(q._col(seq)), q.gc_count(seq)
    off = F.abs(2 * g - n)
    return (
        F.when(n == 0, None)
        .when(5 * g == 3 * n, 0.4)
        .when(10 * off <= 2 * n, 0.0)
        .when(20 * off <= 6 * n, 0.4)
        .when(10 * off <= 4 * n, 0.8)
        .otherwise(1.0)
    )


def gc_window_error(seq) -> Column:
    """min(1, 5 d**2) of the range d of GC over windows of a quarter of the strand, ten bases at least."""
    n = F.length(q._col(seq))
    size = F.least(n, F.greatest(F.floor(n / 4).cast("int"), F.lit(10)))
    w = q.gc_windows(seq, size)
    return F.when(n > 0, F.least(F.lit(1.0), 5 * F.pow(F.array_max(w) - F.array_min(w), 2)))


def run_activation(run) -> Column:
    return 1 - 1 / (1 + F.exp(q._col(run) - MAX_RUN))


def hp_error(seq) -> Column:
    """Mean activation of runs longer than six."""
    long_ = F.transform(q.runs_over(seq, MAX_RUN), F.length)
    total = F.aggregate(long_, F.lit(0.0), lambda a, n: a + run_activation(n))
    return F.when(F.size(long_) > 0, total / F.size(long_)).otherwise(0.0)


def repeats_penalty(count: Column) -> Column:
    """0.001 j for each j of 1 to 19 with count > 5 + 5 j."""
    top = F.least(F.lit(19), F.greatest(F.lit(0), F.ceil((count - 5) / 5) - 1))
    return top * (top + 1) / 2 * 0.001


def _satellites(seq, units: list[str]) -> Column:
    # a count above 10 is the least that costs anything, so most units need no regular expression
    s = q._col(seq)
    out = F.lit(0.0)
    for u in units:
        out = out + F.when(s.contains(u * 11), repeats_penalty(q.count_consecutive(s, u))).otherwise(0.0)
    return out


def satellites_2(seq) -> Column:
    return _satellites(seq, DIMERS)


def satellites_3(seq) -> Column:
    return _satellites(seq, TRIMERS)


def repeat_error(seq, size: int = 9, strict: bool = False) -> Column:
    """Share of k-mers that occur again later: above 0.44 an error of 1, else half the share; strict: any repeat is 1."""
    s = q._col(seq)
    n = F.length(s)
    # a later match must end before the last base
    again = F.filter(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.instr(F.substring(s, i + 2, n - i - 2), F.substring(s, i + 1, F.lit(size))) > 0)
    hits = F.size(again)
    if strict:
        return F.when(n < size, 0.0).when(hits > 0, 1.0).otherwise(0.0)
    share = (1 + hits) * F.lit(float(size)) / n
    return F.when((n < size) | (hits == 0), 0.0).when(share > 0.44, 1.0).otherwise(0.5 * share)


def normalized(error: Column) -> Column:
    """(1 + e**-0.5) / (1 + e**(0.5 - 3 x)) - e**-0.5: 0 at 0, rising to 1."""
    e = F.exp(F.lit(-0.5))
    return (1 + e) / (1 + F.exp(-3 * error + 0.5)) - e


class Rules:
    """Named rules, each a function from a strand column to an error column."""

    def __init__(self, rules: dict[str, Callable] | None = None, frozen: bool = False) -> None:
        self._rules, self._frozen = dict(rules or {}), frozen

    def put(self, rule: Callable, name: str | None = None) -> None:
        self._check()
        self._rules[name or f"rule{len(self._rules)}"] = rule

    def remove(self, name: str) -> Callable | None:
        self._check()
        return self._rules.pop(name, None)

    def _check(self) -> None:
        if self._frozen:
            raise TypeError("these rules are frozen")

    def freeze(self) -> Rules:
        return Rules(self._rules, frozen=True)

    def __iter__(self) -> Iterable[str]:
        return iter(self._rules)

    def error(self, seq, names: Iterable[str] | None = None) -> Column:
        """Normalised sum of the named rules' errors."""
        total = F.lit(0.0)
        for name in names or self._rules:
            total = total + self._rules[name](seq)
        return normalized(total)

    def within(self, df: DataFrame, seq: str, limit: float, names: Iterable[str] | None = None) -> DataFrame:
        """Rows whose error is at most limit; rules run in order and a row leaves as soon as their sum so far exceeds it."""
        total = F.lit(0.0)
        for name in names or self._rules:
            total = total + self._rules[name](seq)
            df = df.where(normalized(total) <= limit)
        return df


BASIC = Rules({"gc": gc_error, "gc_window": gc_window_error, "hp": hp_error, "satellites_2": satellites_2, "satellites_3": satellites_3, "repeats": repeat_error}).freeze()
