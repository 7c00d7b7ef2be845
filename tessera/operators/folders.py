"""A folder of a query's own in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(session: SparkSession) -> str:
    """Below spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = session.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or session.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-")
    return f"{shared.rstrip('/')}/tessera_{uuid.uuid4().hex}"
