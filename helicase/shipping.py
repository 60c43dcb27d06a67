"""Sending this package to executors, so that their Python workers can import it without an installation; dealing out small inputs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_SHIPPED: set[str] = set()


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the cores where its scan has fewer partitions than these; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(df: DataFrame) -> DataFrame:
    """df; the package goes out once per application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="helicase-")) / "helicase.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return df
