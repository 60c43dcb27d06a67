"""Online ingest: a stream of delimited lines becomes strands, buckets of the index and rows of the store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.functions import codecs, minhash


def encoded(lines: DataFrame, key: str, value: str, codec: str = "two_bit") -> DataFrame:
    """(id, seq) of a batch or a stream."""
    return lines.select(F.col(key).cast("long").alias("id"), codecs.named(codec).encode(F.col(value)).alias("seq"))


def start(stream: DataFrame, key: str, value: str, out: str, checkpoint: str, lsh: minhash.Lsh = minhash.Lsh(), codec: str = "two_bit"):
    """A running query that appends strands and their buckets under ``out``; a batch that is run again replaces its own
    folder, so rows come once."""

    def batch(df: DataFrame, number: int) -> None:
        strands = encoded(df, key, value, codec).persist()
        strands.write.mode("overwrite").parquet(f"{out}/strands/batch={number}")
        minhash.index(strands, "id", "seq", lsh).write.mode("overwrite").parquet(f"{out}/index/batch={number}")
        strands.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
