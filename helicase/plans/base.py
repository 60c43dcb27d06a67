"""Registering queries with their SQL twins, and the strand relations that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.functions import seq as q
from helicase.shipping import ship, spread

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_encode(text: str) -> str:
    out = f"lower(hex(encode({text})))"
    for nibble in range(16):
        out = f"replace({out}, '{nibble:x}', '{q.TRANSPORT[nibble >> 2]}{q.TRANSPORT[nibble & 3]}')"
    return out


#: name -> (table, key, text)
STRANDS = {
    "doc": ("documents", "doc_id", "text"),
    "cust": ("customer", "c_custkey", "c_name"),
    "part": ("part", "p_partkey", "p_name"),
    "item": ("benchmark", "item_id", "text"),
}


def texts(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(id, text) of a table's texts."""
    name, key, text = STRANDS[which]
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(text).alias("text"))


def encoded(texts_: DataFrame, key: str = "id") -> DataFrame:
    """(id, seq) of (key, text) at two bits a base."""
    # generated, not projected, so that a strand is encoded once however often it is used and filtered on
    return texts_.select(F.col(key).alias("id"), F.explode(F.array(q.encode_2bit("text"))).alias("seq"))


def strands(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(id, seq) of a table's texts at two bits a base."""
    return encoded(spread(texts(spark, sf_dir, which)))


def sql_strands(which: str) -> str:
    name, key, text = STRANDS[which]
    return f"s AS (SELECT {key} AS id, {sql_encode(text)} AS seq FROM {name})"
