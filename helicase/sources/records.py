"""Fixed-width records: big-endian scalars, fused and repeated, and stores of them keyed by position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@dataclass(frozen=True)
class Record:
    """Fields (numpy type, Spark type) side by side without gaps, most significant byte first. ``many``: an array of one
    field; several fields are a struct with the names a, b, c, ..."""

    fields: tuple[tuple[str, str], ...]
    many: int = 0

    @property
    def dtype(self) -> np.dtype:
        if self.many:
            return np.dtype([("a", self.fields[0][0], (self.many,))])
        return np.dtype([(chr(97 + i), t) for i, (t, _) in enumerate(self.fields)])

    @property
    def size(self) -> int:
        return self.dtype.itemsize

    @property
    def kind(self) -> str:
        """The Spark type of a value."""
        one = self.fields[0][1]
        if self.many:
            return f"array<{one}>"
        return one if len(self.fields) == 1 else "struct<" + ",".join(f"{chr(97 + i)}:{t}" for i, (_, t) in enumerate(self.fields)) + ">"

    def fuse(self, other: Record) -> Record:
        if self.many or other.many:
            raise ValueError("arrays can't be fused")
        return Record(self.fields + other.fields)

    def repeated(self, n: int) -> Record:
        if len(self.fields) > 1 or self.many or n < 1:
            raise ValueError("only single fields repeat, once at least")
        return Record(self.fields, n)

    def encode(self) -> Callable:
        """A column function from values to bytes; a batch at a time. Null for null, and for a null inside."""
        dtype, struct = self.dtype, len(self.fields) > 1

        def packed(s) -> pd.Series:
            there = s.notna().all(axis=1) if struct else s.notna()
            out = np.zeros(int(there.sum()), dtype)
            for i, name in enumerate(dtype.names):
                values = s.iloc[:, i][there] if struct else s[there]
                out[name] = np.stack(values.to_list()) if dtype[name].shape and len(values) else values.to_numpy() if not dtype[name].shape else out[name]
            data, size = out.tobytes(), dtype.itemsize
            made = pd.Series([None] * len(s), dtype=object)
            made[there.to_numpy()] = [data[i : i + size] for i in range(0, len(data), size)]
            return made

        if struct:

            @F.pandas_udf(BinaryType())
            def run(s: pd.DataFrame) -> pd.Series:
                return packed(s)
        else:

            @F.pandas_udf(BinaryType())
            def run(s: pd.Series) -> pd.Series:
                return packed(s)

        return run

    def decode(self) -> Callable:
        """The inverse of encode; bytes of another length are an error."""
        dtype, struct = self.dtype, len(self.fields) > 1

        def values(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            there = s.notna().to_numpy()
            return there, np.frombuffer(b"".join(map(bytes, s[there])), dtype)

        if struct:

            @F.pandas_udf(self.kind)
            def run(s: pd.Series) -> pd.DataFrame:
                there, v = values(s)
                out = pd.DataFrame(index=range(len(s)))
                for name in dtype.names:
                    column = pd.Series([None] * len(s), dtype=object)
                    column[there] = v[name].astype(v[name].dtype.newbyteorder("=")).tolist()
                    out[name] = column
                return out
        else:

            @F.pandas_udf(self.kind)
            def run(s: pd.Series) -> pd.Series:
                there, v = values(s)
                out = pd.Series([None] * len(s), dtype=object)
                plain = v["a"].astype(v["a"].dtype.newbyteorder("=")).tolist()
                for i, x in zip(np.flatnonzero(there), plain, strict=True):
                    out.iat[i] = x
                return out

        return run


INT, LONG, FLOAT, DOUBLE = (Record(((t, k),)) for t, k in ((">i4", "int"), (">i8", "long"), (">f4", "float"), (">f8", "double")))


@dataclass(frozen=True)
class RecordStore:
    """Records under dense keys 0, 1, ...: rows (key, data). A put may replace, and add after the last key without a gap."""

    rows: DataFrame
    record: Record

    @classmethod
    def open(cls, spark: SparkSession, record: Record) -> RecordStore:
        """An empty store; what was there before is gone."""
        return cls(spark.createDataFrame([], "key long, data binary"), record)

    def size(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("size"))

    def put(self, entries: DataFrame) -> RecordStore:
        """Entries (key, value), one a key; a key beyond the end of what is there and put is an error."""
        new = entries.select(F.col("key").cast("long").alias("key"), self.record.encode()(F.col("value")).alias("data"))
        rows = self.rows.join(new.select("key"), "key", "left_anti").unionByName(new)
        n, last = rows.agg(F.count("*"), F.max("key")).first()
        if n and last >= n:
            raise IndexError(f"{n} records can't have a key {last}")
        return RecordStore(rows, self.record)

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) for every key asked for, null where there is none."""
        return keys.select("key").join(self.rows, "key", "left").select("key", self.record.decode()(F.col("data")).alias("value"))

    def remove(self, keys: DataFrame) -> RecordStore:
        raise NotImplementedError("records have fixed places: they can be replaced, not removed")


def read(spark: SparkSession, path: str, record: Record) -> DataFrame:
    """(key, data) of a file of records; a file that is no whole number of them is an error."""
    size = record.size
    whole = spark.read.format("binaryFile").load(path).select("content", F.length("content").alias("n"))
    whole = whole.withColumn("content", F.when(F.col("n") % size == 0, F.col("content")).otherwise(F.raise_error(F.lit(f"no whole number of {size}-byte records")).cast("binary")))
    keys = F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / size).cast("int") - 1))
    return whole.where("n > 0").select(keys.alias("key"), "content").select(F.col("key").cast("long"), F.substring(F.col("content"), F.col("key") * size + 1, F.lit(size)).alias("data"))
