"""What the operators of this subpackage share: reading, checkpoints, partition counts, native word expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.shipping import ship, spread  # noqa: F401
from helicase.tables import checkpoint  # noqa: F401

#: A word of most contracts: anything but ASCII white space. Same pattern in Java and RE2.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def scan_bytes(df: DataFrame) -> int:
    """Bytes that a plan reads: Catalyst's estimates of its leaves, which for scans are the bytes of their files. It needs
    no job and works on any store. Leaves without an estimate count 16 MB a partition."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)
    return known if all(s < 1 << 60 for s in sizes) else known + (df.rdd.getNumPartitions() << 24)


def fan_out(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for an exchange of what is derived from df: in proportion to its bytes, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(scan_bytes(df) / bytes_each), 1)
