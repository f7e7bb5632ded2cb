"""The same table functions over streams: parsing has no state, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.nodes import diagnose, parse_nodes
from ..sources.files import stream_documents


def stream_nodes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Node rows of files as they arrive below ``path``."""
    return parse_nodes(stream_documents(spark, path, glob), F.col("dialect"))


def stream_diagnostics(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return diagnose(stream_documents(spark, path, glob), F.col("dialect"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to Parquet and stop when all files that are there have been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
