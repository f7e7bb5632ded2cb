"""Nim source as table functions: tokens, trees, diagnostics, completeness."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialects import nim, nim_checks, nim_tree
from ..dialects.tree import Positions
from .nodes import BATCH_ROWS, DIAGNOSTICS, NODES, diagnostic_batch, document_keys, node_batch

TOKENS = "doc_id long, doc_key long, tok_id int, kind string, text string, line int, col int, end_col int, indent int, int_value long, float_value double, suffix string, quoted boolean, parts array<string>"


def _texts(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("content"))


def _utf8(text: str) -> str:
    return text.encode("latin-1", "replace").decode("utf-8", "replace")


def tokenize(docs: DataFrame, options: nim.Options = nim.Options(), id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Tokens of each source, the last an ``eof``; comments that do not lead their line are dropped."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = document_keys()
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = next(keys)
                found, _ = nim.tokenize(content.decode("latin-1"), options)
                rows = [(doc, key, i, t.kind, _utf8(t.text), t.line, t.col, t.end_col, t.indent, t.int_value, t.float_value, t.suffix, t.quoted, [_utf8(p) for p in t.parts]) for i, t in enumerate(found)]
                for at in range(0, len(rows), BATCH_ROWS):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + BATCH_ROWS], strict=True), kinds, strict=True)], names=names)

    return _texts(docs, id_col, content_col).mapInArrow(run, TOKENS)


def parse_nodes(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """The decoded tree of each source as a node table; empty slots are ``empty`` nodes, atoms hold their value in ``raw``.

    Unlike the lossless dialects this tree cannot be rendered back.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, keys = [], 0, document_keys()
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = nim_tree.parse(content.decode("latin-1"))
                held.append((doc, next(keys), tree))
                rows += len(tree.tags)
                if rows >= BATCH_ROWS:
                    yield node_batch(held)[0]
                    held, rows = [], 0
        if held:
            yield node_batch(held)[0]

    return _texts(docs, id_col, content_col).mapInArrow(run, NODES)


def diagnose(docs: DataFrame, options: nim.Options = nim.Options(), lints: tuple[str, ...] = (), curly: bool = False, grammar: bool = False, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Lexical, bracket and grammar diagnostics and those of the named lints, in source order.

    ``grammar`` adds what the tree parser had to cope with.  A source with a
    ``#?`` filter has none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = document_keys()
        for batch in batches:
            rows: list[tuple] = []
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = next(keys)
                source = content.decode("latin-1")
                if source.lstrip(" \t\r\n").startswith("#?"):
                    continue
                tokens, found = nim.tokenize(source, options)
                coped = nim_tree.parse(source).diagnostics[len(found) :] if grammar else []
                found = found + nim.check_brackets(tokens) + nim_checks.check(tokens, lints, curly) + coped
                places = Positions(source)
                at = [places.of(np.array([d.at, max(0, d.related_at)])) for d in found]
                order = sorted(range(len(found)), key=lambda i: (at[i][0][0], at[i][1][0]))
                for n, i in enumerate(order):
                    d, (line, col) = found[i], at[i]
                    related = {"message": d.related, "line": int(line[1]), "col": int(col[1])} if d.related else None
                    rows.append((doc, key, n, d.severity, d.code, d.message, int(line[0]), int(col[0]), int(col[0]) + d.width, d.fix, related))
            if rows:
                yield diagnostic_batch(rows)

    return _texts(docs, id_col, content_col).mapInArrow(run, DIAGNOSTICS)


def completeness(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, verdict (complete, incomplete, invalid), reason, detail of each source."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nim.completeness(c.decode("latin-1")) for c in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array([_utf8(x) for x in c], pa.string()) for c in columns)], names=["doc_id", "verdict", "reason", "detail"])

    return _texts(docs, id_col, content_col).mapInArrow(run, "doc_id long, verdict string, reason string, detail string")
