"""Random draws as columns, each by a given seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(low: float, high: float, seed: int) -> Column:
    return low + (high - low) * F.rand(seed)


def choose(low: int, high: int, seed: int) -> Column:
    """A whole number from low to high, both included."""
    return F.floor(low + (high - low + 1) * F.rand(seed)).cast("int")


def gaussian(seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return mean + deviation * F.randn(seed)


def power_law(exponent: float, cutoff: float, seed: int) -> Column:
    """Density falling as x ** exponent from 1, for exponents below -1, up to the cutoff."""
    rest = exponent + 1
    return F.pow((cutoff**rest - 1) * F.rand(seed) + 1, F.lit(1 / rest))


def pick(values: Column, seed: int) -> Column:
    return F.element_at(values, (F.floor(F.rand(seed) * F.size(values)) + 1).cast("int"))
