"""What the operators of this subpackage share: the shared folder, checkpoints, texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine and where the session names no shared folder, as in tests.
FALLBACK_CHECKPOINT_DIR = "/tmp/treeloom-checkpoints"
#: Keys are common if more than this many rows have them, and more than such a part of all rows.
COMMON_LEAST, COMMON_MOST = 1000, 10_000
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a default where it is unset and all is on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{FALLBACK_CHECKPOINT_DIR}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for held in _open:
        held.append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are given out in the shared folder meanwhile, for who can say when none of them is needed any more."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def checkpoint(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends at the written table, which survives lost executors, and
    readers prune its columns.  The table stays until it is dropped; see :func:`collected`.
    """
    return written(df, what)[0]


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """A checkpoint and its path, for who can say when it is not needed any more."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written and is not referred to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_with_common(rows: DataFrame, found: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``found``, which has each key once and how many rows have it in ``n``.

    Rows of a key that very many have do not move: such keys are broadcast,
    COMMON_MOST of them at most.  ``found`` is read three times and should be a checkpoint.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    share = max(COMMON_LEAST, total // COMMON_MOST)
    common = F.broadcast(found.filter(F.col(n) > share))
    others = rows.join(common.select(key), key, "left_anti").join(found.filter(F.col(n) <= share), key)
    return others.unionByName(rows.join(common, key))


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def by_bytes(batches: Iterator, columns: tuple[str, ...], limit: int) -> Iterator[list[tuple]]:
    """Rows of Arrow batches, the last column a text, in lists of about ``limit`` bytes of it.

    A single longer text makes a list of its own.
    """
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            rows.append(row)
            size += len(row[-1] or "")
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows
