"""Files as documents, and documents as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import with_dialect


def read_documents(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """doc_id (a hash of the path), path, dialect, content of the files below ``path``, a whole file a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return with_dialect(files.select(F.xxhash64("path").alias("doc_id"), "path", "content"))


def stream_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """As :func:`read_documents`, as files arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return with_dialect(files.select(F.xxhash64("path").alias("doc_id"), "path", "content"))


def inline_document(spark: SparkSession, content: str | bytes, label: str = "stdin") -> DataFrame:
    """A document given as text."""
    data = content.encode() if isinstance(content, str) else content
    return with_dialect(spark.createDataFrame([(0, label, bytearray(data))], "doc_id long, path string, content binary"))


def path_label(path: Column, base: str = "") -> Column:
    """A path relative to ``base``, with forward slashes."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[a-z]+:/*(?=/)", "")
    return F.when(plain.startswith(base.rstrip("/") + "/"), F.substring(plain, F.lit(len(base.rstrip("/")) + 2), F.length(plain))).otherwise(plain) if base else plain


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.parquet(path)
