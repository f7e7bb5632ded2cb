"""Sharding by extendible hashing.

A directory of hash-prefix bits starts as one bucket.  A bucket that holds
more bytes than a shard may splits on its next bit, and only that bucket, so
the directory is deep where the data is heavy and shallow elsewhere.  Sizes of
all prefixes of a level range come from one aggregation over small cells;
documents never move before their shard is known.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_of

#: Bits of the hash that the directory may use, and levels that one pass resolves.
HASH_BITS, STEP_BITS = 60, 12
#: Default bytes of text in a shard.
SHARD_BYTES = 32 << 20


def hash_bits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the MD5 of id and text, as a long."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text_of(text_col))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(column: Column, bits: Column | int) -> Column:
    """The first ``bits`` of a hash."""
    return F.expr(f"shiftright(__h, {HASH_BITS} - ({bits}))") if isinstance(bits, int) else F.call_function("shiftright", column, F.lit(HASH_BITS) - bits)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory of rows ``(__h, __n)``: depth, prefix, shard_bytes, shard_rows, pages.

    ``pages`` is over 1 for a leaf that no further bit can split (rows of one
    hash value) and that is still too large.
    """
    total = sized.agg(F.sum("__n")).first()[0] or 0
    step = max(STEP_BITS, min(22, math.ceil(math.log2(max(1, total / limit))) + 4))
    leaves, open_at, base = [], None, 0
    while True:
        rows = sized
        if open_at is not None:
            rows = sized.withColumn("__p", _prefix(F.col("__h"), base)).join(open_at, "__p", "left_semi")
        depth = min(HASH_BITS, base + step)
        cells = rows.groupBy(_prefix(F.col("__h"), depth).alias("cell")).agg(F.sum("__n").alias("n"), F.count("*").alias("c"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))
        nodes = (
            cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
            .withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
            .groupBy("depth", "prefix")
            .agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )
        nodes = nodes.withColumn("open", (F.col("n") > limit) & (F.col("c") > 1) & (F.col("lo") < F.col("hi")))
        parents = nodes.filter("open").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        below = nodes.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(parents, ["depth", "up"], "left_semi")
        kept = checkpoint(nodes.filter(F.col("depth") == base).unionByName(below.select(nodes.columns)), "directory")
        fits = (~F.col("open")).cast("boolean")
        leaves.append(kept.filter(fits))
        still = kept.filter(F.col("open") & (F.col("depth") == depth))
        if depth == HASH_BITS or still.isEmpty():
            break
        open_at, base = still.select(F.col("prefix").alias("__p")), depth
    out = leaves[0]
    for part in leaves[1:]:
        out = out.unionByName(part)
    pages = F.when((F.col("c") > 1) & (F.col("n") > limit), F.ceil(F.col("n") / limit)).otherwise(1)
    return out.select("depth", "prefix", F.col("n").alias("shard_bytes"), F.col("c").alias("shard_rows"), pages.cast("long").alias("pages"))


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of each row: doc_id, shard_id, n_bytes, shard_bytes, oversize.

    ``shard_id`` is the bucket's hash prefix in bits (empty for the whole
    table).  A null text has no bytes; a null id hashes as an empty one.  A
    single text over ``limit`` has a shard of its own with ``oversize`` true.
    Rows that repeat both id and text cannot be told apart by a hash: where
    they exceed the limit together they fill pages ``<bits>.0``, ``<bits>.1``
    and so on.  Only id and text are read; no rows give no rows.
    """
    placed = _placed(docs, [F.col(id_col).cast("long").alias("doc_id")], limit, id_col, text_col)
    return placed.select("doc_id", F.col("__shard").alias("shard_id"), F.col("__n").alias("n_bytes"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def _placed(docs: DataFrame, carried: list[Column], limit: int, id_col: str, text_col: str) -> DataFrame:
    """The columns ``carried`` of each row with its shard: __shard, __n and shard_bytes."""
    rows = docs.select(*carried, hash_bits(id_col, text_col).alias("__h"), F.octet_length(text_of(text_col)).cast("long").alias("__n"))
    names = rows.columns[: len(carried)]
    leaves = directory(rows.select("__h", "__n"), limit)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most one value a bit
    if not depths:
        depths = [0]
    at = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("prefix", _prefix(F.col("__h"), F.col("depth")))
    placed = at.join(leaves, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    whole = placed.filter("pages = 1").select(*names, bits.alias("__shard"), "__n", "shard_bytes")
    if leaves.filter("pages > 1").isEmpty():
        return whole
    return whole.unionByName(_pages(placed.filter("pages > 1"), names, bits, limit))


def _pages(placed: DataFrame, names: list[str], bits: Column, limit: int) -> DataFrame:
    """Equal rows of a leaf, filled into pages; all are of one size.

    Rows are ranked within the partition that they come from, which goes on from
    the numbers of rows of those before it, so no task has all of a leaf.
    """
    part = ["depth", "prefix", "__part"]
    held = checkpoint(placed.withColumn("__part", F.spark_partition_id()), "pages")
    before = Window.partitionBy("depth", "prefix").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part).count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("__n"))))
    rank = F.row_number().over(Window.partitionBy(part).orderBy("__n")) - 1
    ranked = held.withColumn("__rank", rank).join(counts, part)
    ranked = ranked.withColumn("__page", F.floor((F.col("__rank") + F.col("__before")) / each))
    size = F.least(each, F.col("shard_rows") - F.col("__page") * each) * F.col("__n")
    return ranked.select(*names, F.concat(bits, F.lit("."), F.col("__page").cast("string")).alias("__shard"), "__n", size.cast("long").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard_id") -> None:
    """Write ``docs`` with one folder for each shard, each by one task.

    Every row is written once, whatever it repeats.  Folders are named by
    ``shard_col`` and the bits of the shard after a ``b``, so that they are read back as text;
    where ``docs`` has a column of that name, underscores are added to it.
    """
    while shard_col in docs.columns:
        shard_col += "_"
    placed = _placed(docs, [F.struct(*docs.columns).alias("__row")], limit, id_col, text_col)
    named = placed.select("__row.*", F.concat(F.lit("b"), "__shard").alias(shard_col))
    named.repartition(shard_col).write.partitionBy(shard_col).parquet(path)
