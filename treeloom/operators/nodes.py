"""Table functions: documents to node, token and diagnostic rows.

A parser keeps no state between documents, so each is a narrow Arrow map over
whatever partitions the documents come in: no shuffle, and the same code over a
stream.  Push filters on documents below the map.  A filter on tags cannot pass
through it, so it is an argument, as is what should be known of the nodes
around a node: a query then parses once and joins nothing.

Ids may be null or repeated.  ``doc_key`` tells the rows of a document table
apart: it numbers the documents of a partition, as monotonically_increasing_id does.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialects.context import Context
from ..dialects.specs import dialect, dialect_rows, node_spec_rows
from ..dialects.tree import Positions, Tree

NODES = "doc_id long, doc_key long, node_id int, parent_id int, end_id int, depth int, tag string, raw binary, line int, col int"
TOKENS = "doc_id long, doc_key long, tok_id int, kind string, raw binary, line int, col int"
DIAGNOSTICS = "doc_id long, doc_key long, diag_id int, severity string, code string, message string, line int, col int, end_col int, fix string, related struct<message:string,line:int,col:int>"
#: Rows of an Arrow batch that goes back to the JVM.
BATCH_ROWS = 20_000


def spec_table(spark: SparkSession) -> DataFrame:
    """dialect, tag, kind, lit: a static table of under 200 rows."""
    return spark.createDataFrame(node_spec_rows(), "dialect string, tag string, kind string, lit string")


def dialect_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dialect_rows(), "name string, command string, exts array<string>, summary string")


def _inputs(docs: DataFrame, which: str | Column, id_col: str, content_col: str) -> DataFrame:
    """doc_id, dialect, content as bytes."""
    named = F.lit(dialect(which).name) if isinstance(which, str) else which
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), named.alias("dialect"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("content"))


def document_keys() -> Iterator[int]:
    """Keys for the documents that a task meets, in order."""
    context = TaskContext.get()
    return count((context.partitionId() if context else 0) << 33)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str]]:
    keys = document_keys()
    for batch in batches:
        for doc, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = next(keys)
            if name is not None:
                yield doc, key, name, content.decode("latin-1")


Held = list[tuple[int | None, int, Tree]]


def _places(tree: Tree, own: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
    """Lines and columns of nodes; a few are looked up one by one."""
    offsets = _picked(tree.offsets, own)
    places = Positions(tree.text)
    if len(own) > 100:
        line, col = places.of(np.array(offsets, np.int64))
        return line.tolist(), col.tolist()
    starts = places.starts.tolist()
    line = [bisect_right(starts, at) for at in offsets]
    return line, [at - starts[n - 1] for at, n in zip(offsets, line, strict=True)]


def node_batch(held: Held, tags: frozenset[str] | None = None) -> tuple[pa.RecordBatch, list[Sequence[int]]]:
    """Rows of the nodes, or of those with ``tags``, and their numbers in each tree."""
    use = [range(len(t.tags)) if tags is None else [i for i, x in enumerate(t.tags) if x in tags] for _, _, t in held]
    line: list[int] = []
    col: list[int] = []
    for (_, _, tree), own in zip(held, use, strict=True):
        a, b = _places(tree, own)
        line += a
        col += b
    flat = lambda name, kind: pa.array([x for (_, _, t), own in zip(held, use, strict=True) for x in _picked(getattr(t, name), own)], kind)
    at = pa.array(np.repeat(np.arange(len(held)), [len(own) for own in use]))
    batch = pa.record_batch(
        [
            pa.array([d for d, _, _ in held], pa.int64()).take(at), pa.array([k for _, k, _ in held], pa.int64()).take(at),
            pa.array([i for own in use for i in own], pa.int32()),
            flat("parents", pa.int32()), flat("ends", pa.int32()), flat("depths", pa.int32()), flat("tags", pa.string()),
            pa.array([x for (_, _, t), own in zip(held, use, strict=True) for x in t.raws(own)], pa.binary()),
            pa.array(line, pa.int32()), pa.array(col, pa.int32()),
        ],
        names=[x.split()[0] for x in NODES.split(", ")],
    )
    return batch, use


def _picked(values: Sequence, own: Sequence[int]) -> Sequence:
    return values if isinstance(own, range) else [values[i] for i in own]


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[Held]:
    """Parsed documents, about BATCH_ROWS nodes at a time."""
    held: Held = []
    rows = 0
    for doc, key, name, text in _documents(batches):
        tree = dialect(name).parse(text)
        held.append((doc, key, tree))
        rows += len(tree.tags)
        if rows >= BATCH_ROWS:
            yield held
            held, rows = [], 0
    if held:
        yield held


def parse_nodes(
    docs: DataFrame, which: str | Column, id_col: str = "doc_id", content_col: str = "content", tags: tuple[str, ...] | None = None, carry: dict[str, tuple[str, Context]] | None = None
) -> DataFrame:
    """The node table of ``docs``; ``which`` is a dialect or a column of dialect names, null for none.

    Nodes are numbered in document order; the nodes below n are those from
    n.node_id + 1 to n.end_id - 1, and node 0, the root, is there even of an empty
    document.  ``raw`` is the text of a leaf, null for structure and
    punctuation.  ``line`` counts from 1 and ``col`` from 0, in bytes.  A null
    content is an empty document.  Malformed input never fails.  With ``tags``
    only nodes that have one of them are returned.  Each entry of ``carry`` adds
    a column, by its type and a function of :mod:`treeloom.dialects.context`.
    """
    carry, wanted = carry or {}, None if tags is None else frozenset(tags)
    kinds = {name: pa.int32() if kind == "int" else pa.string() for name, (kind, _) in carry.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _trees(batches):
            batch, use = node_batch(held, wanted)
            more = []
            for name, (_, context) in carry.items():
                more.append(pa.array([x for (_, _, t), own in zip(held, use, strict=True) for x in map(context(t), own)], kinds[name]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *carry])

    return _inputs(docs, which, id_col, content_col).mapInArrow(run, NODES + "".join(f", {name} {kind}" for name, (kind, _) in carry.items()))


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TOKENS.split(", ")]
    for doc, key, name, text in _documents(batches):
        found = dialect(name).tokens(text)
        line, col = Positions(text).of(np.array([t[1] for t in found], np.int64))
        for at in range(0, len(found), BATCH_ROWS):
            part = found[at : at + BATCH_ROWS]
            yield pa.record_batch(
                [pa.array([doc] * len(part), pa.int64()), pa.array([key] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array([t[0] for t in part], pa.string()), pa.array([text[a:b].encode("latin-1") for _, a, b in part], pa.binary()), pa.array(line[at : at + len(part)].astype(np.int32)), pa.array(col[at : at + len(part)].astype(np.int32))],
                names=names,
            )


def tokenize(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Tokens of the dialects that have a tokenizer (css, html, py, js, json, vds); their texts add up to the document."""
    if dialect(which).tokens is None:
        raise ValueError(f"{which} is read line by line and has no tokens")
    return _inputs(docs, which, id_col, content_col).mapInArrow(_tokens, TOKENS)


_RELATED = pa.struct([("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])


def diagnostic_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), _RELATED]
    names = ["doc_id", "doc_key", "diag_id", "severity", "code", "message", "line", "col", "end_col", "fix", "related"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _diagnostics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for doc, key, name, text in _documents(batches):
        found = dialect(name).parse(text).diagnostics
        if not found:
            continue
        places = Positions(text)
        where = lambda at: tuple(int(x[0]) for x in places.of(np.array([at]))) if at >= 0 else (0, 0)  # noqa: E731, B023
        for i, d in enumerate(found):
            line, col = where(d.at)
            related = None
            if d.related and d.related_at != d.at:
                to = where(d.related_at)
                related = {"message": d.related, "line": to[0], "col": to[1]}
            rows.append((doc, key, i, d.severity, d.code, d.message, line, col, col + d.width, d.fix, related))
        if len(rows) >= BATCH_ROWS:
            yield diagnostic_batch(rows)
            rows = []
    if rows:
        yield diagnostic_batch(rows)


def diagnose(docs: DataFrame, which: str | Column, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Diagnostics of ``docs``, ``diag_id`` in the order in which the parser met them."""
    return _inputs(docs, which, id_col, content_col).mapInArrow(_diagnostics, DIAGNOSTICS)


def mapped(docs: DataFrame, which: str, of: Callable[[Tree], tuple], schema: str, types: list[pa.DataType], id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id and what ``of`` says of each document's tree: a row for each row of ``docs``, whatever its id, and no shuffle."""
    parse, names = dialect(which).parse, [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(parse(content.decode("latin-1"))) for content in batch.column(2).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return _inputs(docs, which, id_col, content_col).mapInArrow(run, f"doc_id long, {schema}")
