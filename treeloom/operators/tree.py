"""Questions about node tables, answered by ordinary DataFrame operations.

Documents are told apart by doc_id and doc_key, so ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dialects.specs import dialect
from .nodes import spec_table

DOC = ("doc_id", "doc_key")


def _spec(nodes: DataFrame, which: str) -> DataFrame:
    # A static table of under 200 rows: it may be broadcast at any scale.
    return F.broadcast(spec_table(nodes.sparkSession).filter(F.col("dialect") == dialect(which).name).drop("dialect"))


def count_tag(nodes: DataFrame, *tags: str) -> DataFrame:
    """doc_id, doc_key and n, how many nodes of a document have one of ``tags``; 0 for documents of which ``nodes`` has others only."""
    return nodes.groupBy(*DOC).agg(F.count_if(F.col("tag").isin(*tags)).alias("n"))


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def nesting(nodes: DataFrame, tag: str) -> DataFrame:
    """doc_id, doc_key, n and depth: how many nodes of ``tag`` a document has and how deep they stand in each other, by a running sum over their starts and ends."""
    own = nodes.filter(F.col("tag") == tag)
    edges = own.select(*DOC, F.explode(F.array(F.struct(F.col("node_id").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_id").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*DOC, "e.at", "e.step")
    order = Window.partitionBy(*DOC).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("open", F.sum("step").over(order)).groupBy(*DOC).agg(F.count_if(F.col("step") == 1).alias("n"), F.max("open").cast("long").alias("depth"))


def max_nesting(nodes: DataFrame, tag: str) -> DataFrame:
    """doc_id, doc_key and depth of :func:`nesting`."""
    return nesting(nodes, tag).drop("n")


def undeclared_tags(nodes: DataFrame, which: str) -> DataFrame:
    """doc_id, doc_key, tag and first place of the tags that the dialect does not declare."""
    return nodes.join(_spec(nodes, which), "tag", "left_anti").groupBy(*DOC, "tag").agg(F.min("node_id").alias("first_node"))


def spec_violations(nodes: DataFrame, which: str) -> DataFrame:
    """Text and opaque nodes without text, punctuation and structure with text."""
    kind = F.coalesce("kind", F.lit("struct"))
    wrong = F.when(kind.isin("text", "opaque"), F.col("raw").isNull()).otherwise(F.col("raw").isNotNull())
    return nodes.join(_spec(nodes, which), "tag", "left").withColumn("kind", kind).filter(wrong)


def spec_problems(spec: DataFrame) -> DataFrame:
    """dialect, tag and problem of a declaration table: empty or repeated tags, literals where there should be none or missing."""
    repeated = spec.groupBy("dialect", "tag").agg(F.count("*").alias("c")).filter("c > 1").select("dialect", "tag", F.lit("declared more than once").alias("problem"))
    bad = F.when(F.coalesce("tag", F.lit("")) == "", "empty tag").when((F.col("kind") == "punct") & (F.coalesce("lit", F.lit("")) == ""), "punctuation without a literal").when((F.col("kind") != "punct") & (F.coalesce("lit", F.lit("")) != ""), "a literal outside punctuation")
    return spec.withColumn("problem", bad).filter("problem is not null").select("dialect", "tag", "problem").unionByName(repeated)


def render(nodes: DataFrame, which: str) -> DataFrame:
    """doc_id, doc_key and content: the bytes that the tree stands for, in document order.

    Text nodes give their text and punctuation its literal; structure gives
    nothing, and nothing below an opaque node is source text.  An empty document
    has its root and so a row.  A document's pieces meet in one task: one group
    is one document.
    """
    piece = F.when(F.col("kind") == "text", F.col("raw")).when(F.col("kind") == "punct", F.col("lit").cast("binary"))
    pieces = nodes.select(*DOC, "node_id", "tag", "raw").join(_spec(nodes, which), "tag", "left").select(*DOC, "node_id", piece.alias("piece"))
    pieces = pieces.filter("piece is not null or node_id = 0")
    return pieces.groupBy(*DOC).agg(F.expr("coalesce(listagg(piece) within group (order by node_id), x'')").alias("content"))


def text(column: str = "raw") -> Column:
    """The bytes of a node as a string."""
    return F.decode(F.col(column), "UTF-8")


def descendants(nodes: DataFrame, above: Column, below: Column) -> DataFrame:
    """Pairs of a node for which ``above`` holds and one under it for which ``below`` does: doc_id, doc_key, up.*, down.* as structs.

    The pairs are made within a document, from one read of ``nodes``.
    """
    node = F.struct("node_id", "end_id", "parent_id", "tag", "raw")
    both = nodes.filter(above | below).groupBy(*DOC).agg(F.collect_list(F.when(above, node)).alias("ups"), F.collect_list(F.when(below, node)).alias("downs"))
    pairs = both.select(*DOC, F.explode("ups").alias("up"), "downs")
    under = F.filter("downs", lambda d: (d["node_id"] > F.col("up.node_id")) & (d["node_id"] < F.col("up.end_id")))
    return pairs.select(*DOC, "up", F.explode(under).alias("down"))
