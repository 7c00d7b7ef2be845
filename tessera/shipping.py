"""What is sent to workers: the package as a zip, for those that have no path to it, and the
rows of a table too small to have a part for each core."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code through Spark's file server, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files in as many parts as there are cores. One with as many already, as any
    large table has, is left as it is, so no large table is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if not scan.isStreaming and scan.rdd.getNumPartitions() < cores else scan
