"""The text operators under Structured Streaming. All are stateless, row by row, so a
stream needs no watermark and recovers from its checkpoint alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.functions.sql import format_corpus
from tessera.plans.tables import parse_plans


def format_stream(files: DataFrame) -> DataFrame:
    """(path, text, output, error, changed) of a stream of scripts."""
    return format_corpus(files)


def plan_stream(captures: DataFrame) -> DataFrame:
    """A stream of captures with `parsed`; tables.plan_nodes and the like apply to it."""
    return parse_plans(captures)


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends a stream to a Parquet folder; start() begins, once with trigger(availableNow=True)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
