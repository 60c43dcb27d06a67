"""Small tools over columns and frames: pairs of lists, fallbacks, content hashes, two-way maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.functions.seq import _col


def zip_outer(a: Column, b: Column) -> Column:
    """Structs (x, y) of two arrays' elements, null where one is shorter."""
    return F.arrays_zip(a.alias("x"), b.alias("y"))


def enumerated(items: Column) -> Column:
    """Generates (i, item)."""
    return F.posexplode(items)


def parse_number(text) -> Column:
    """The first digits in a text as a number; null without any."""
    return F.try_to_number(F.nullif(F.regexp_extract(_col(text), r"(\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def shuffled(items: Column, seed: int) -> Column:
    return F.shuffle(items, seed)


def content_hash(*columns) -> Column:
    """A digest of several values' contents, arrays included; equal values, equal digests."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_col(x).cast("string"), F.lit("null")) for x in columns]))


def try_or(value: Column, other: Column) -> Column:
    """value, which is null where it fails, or else another."""
    return F.coalesce(value, other)


def unless(value: Column, holds: Callable[[Column], Column], other: Column) -> Column:
    """value where the condition holds, else another; null counts as not holding."""
    return F.when(holds(value), value).otherwise(other)


def or_fail(value: Column, message: str) -> Column:
    """value; an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)))


def bytes_of(numbers: Column) -> Column:
    """An array of bytes (-128 to 255) as binary."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(255))), 2, "0")), ""))


def clock_seed(at) -> Column:
    """A seed from a time: its milliseconds."""
    return F.unix_millis(_col(at))


def spread_over(df: DataFrame, parallel: bool, parts: int) -> DataFrame:
    """df in so many partitions, or in one."""
    return df.repartition(parts) if parallel else df.coalesce(1)


@dataclass(frozen=True)
class TwoWay:
    """A one-to-one table (left, right), looked up either way."""

    rows: DataFrame

    def get(self, keys: DataFrame) -> DataFrame:
        """(left, right) of keys (left)."""
        return keys.join(self.rows, "left", "left").select("left", "right")

    def back(self, keys: DataFrame) -> DataFrame:
        """(right, left) of keys (right)."""
        return keys.join(self.rows, "right", "left").select("right", "left")

    def put(self, pairs: DataFrame) -> TwoWay:
        """Pairs replace those that share either side with them."""
        kept = self.rows.join(pairs.select("left"), "left", "left_anti").join(pairs.select("right"), "right", "left_anti")
        return TwoWay(kept.unionByName(pairs.select("left", "right")))
