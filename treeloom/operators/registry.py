"""Which dialect a file is of, by its extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialects.specs import DIALECTS, NIM_EXTENSIONS
from .nodes import dialect_table, spec_table


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, of the last part of a path; empty without one."""
    last = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.translate(last, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_dialect(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with ``dialect``: nim for Nim source, a registered name, or null for an unknown extension."""
    known = {e: d.name for d in DIALECTS for e in d.extensions} | dict.fromkeys(NIM_EXTENSIONS, "nim")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return files.withColumn("dialect", F.try_element_at(table, extension(F.col(path_col))))


def unknown_extensions(files: DataFrame, path_col: str = "path") -> DataFrame:
    """path and error of the files that no dialect reads."""
    return with_dialect(files, path_col).filter("dialect is null").select(path_col, F.concat(F.lit("no dialect reads '"), extension(F.col(path_col)), F.lit("'; known are "), F.lit(known_extensions())).alias("error"))


def known_extensions() -> str:
    return " ".join([*NIM_EXTENSIONS, *(e for d in DIALECTS for e in d.extensions)])


def listing(spark: SparkSession) -> DataFrame:
    """name, command, exts, summary, and how many nodes of each kind a dialect declares (opaque ones in the total only)."""
    counts = spec_table(spark).groupBy(F.col("dialect").alias("name")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("text", "punct", "struct")), F.count("*").alias("total"))
    return dialect_table(spark).join(counts, "name").select("name", "command", F.array_join("exts", " ").alias("exts"), "summary", "text", "punct", "struct", "total")


def has_source_filter(content: Column) -> Column:
    """Whether the first text of a source is ``#?``, which hands it to another tool."""
    return content.rlike(r"^[ \t\r\n]*#\?")
