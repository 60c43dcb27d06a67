"""Tables between steps: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder, or the one that spark.checkpoint.dir names. Without either, a
    folder of this machine serves where the executors are threads of the driver; elsewhere it's an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="helicase-checkpoint-"))
    return f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table. It carries no constraints of the plan along, which multiply over rounds, and
    takes less disk than DataFrame.checkpoint(). The folder is the application's own and can go when it ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
