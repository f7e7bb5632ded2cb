"""Strict JSON as table functions: tapes, lint, path queries, members and elements.

Where spelling, duplicate keys and strictness do not matter, Spark's own
``get_json_object`` stays in the JVM and is the faster choice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from json import dumps
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialects.tree import Positions
from ..functions import json_tape as jt
from .nodes import document_keys
from .tree import DOC

TAPE = "doc_id long, doc_key long, idx int, kind string, escaped boolean, start int, size int, next int, parent int, depth int, ordinal int, is_key boolean, key string, lexeme string, value string"
_BATCH = 20_000


def _content(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc, (content or b"").decode("latin-1")


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _shown(text: str, found: list[jt.Entry], entry: jt.Entry) -> str | None:
    return None if entry.kind in ("object", "array") else _utf8(jt.lexeme(text, entry))


#: What a column of the tape says of an entry.
_COLUMNS = {
    "key": lambda text, found, e: _utf8(jt.decoded(text, found[e.key])) if e.key >= 0 else None,
    "lexeme": _shown,
    "value": lambda text, found, e: _utf8(jt.decoded(text, e)) if e.kind == "string" else None,
}


def tape(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", columns: tuple[str, ...] | None = None, depth: int | None = None, values: bool = False) -> DataFrame:
    """The tape of every valid document; an invalid one, null among them, gives no row (see :func:`lint`).

    A projection or a filter cannot pass through the parser's map, so they are
    arguments: ``columns`` besides doc_id and doc_key, entries of one ``depth``,
    and ``values`` for entries that are no keys.
    """
    kinds = dict(x.split() for x in TAPE.split(", "))
    chosen = [n for n in kinds if columns is None or n in columns or n in DOC]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in chosen}

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(held[n], arrow[kinds[n]]) for n in chosen], names=chosen)
            for column in held.values():
                column.clear()
            return made

        for key, (doc, text) in zip(document_keys(), _texts(batches), strict=False):
            try:
                found = jt.parse(text)
            except jt.JsonError:
                continue
            use = found if depth is None and not values else [e for e in found if (depth is None or e.depth == depth) and not (values and e.is_key)]
            for name, column in held.items():
                if name in DOC:
                    column += [doc if name == "doc_id" else key] * len(use)
                elif name == "idx":
                    column += range(len(found)) if use is found else [i for i, e in enumerate(found) if (depth is None or e.depth == depth) and not (values and e.is_key)]
                elif name in _COLUMNS:
                    of = _COLUMNS[name]
                    column += [of(text, found, e) for e in use]
                else:
                    column += map(attrgetter(name), use)
            if len(held["doc_key"]) >= _BATCH:
                yield batch()
        if held["doc_key"]:
            yield batch()

    return _content(docs, id_col, content_col).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in chosen))


def lint(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, valid, error, byte, line and col of the first fault (line and col from 1); a null is an empty document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in _texts([batch]):
                try:
                    jt.parse(text)
                    rows.append((doc, True, None, None, None, None))
                except jt.JsonError as e:
                    line, col = Positions(text).of(np.array([e.at]))
                    rows.append((doc, False, e.message, e.at, int(line[0]), int(col[0]) + 1))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "valid", "error", "byte", "line", "col"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, valid boolean, error string, byte int, line int, col int")


def value_or_error(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, value and error: members, elements or scalar of each valid document as a JSON array of {key, kind, lexeme}, else ``<message> at offset <byte>``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in _texts([batch]):
                try:
                    found = jt.parse(text)
                except jt.JsonError as e:
                    rows.append((doc, None, f"{e.message} at offset {e.at}"))
                    continue
                root = [e for e in found if e.depth == 1 and not e.is_key] if found[0].kind in ("object", "array") else found
                parts = [{"key": _COLUMNS["key"](text, found, e), "kind": e.kind, "lexeme": _shown(text, found, e)} for e in root]
                rows.append((doc, dumps([{k: v for k, v in part.items() if v is not None} for part in parts], ensure_ascii=False, separators=(",", ":")), None))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["doc_id", "value", "error"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, value string, error string")


def query_all(docs: DataFrame, paths: Sequence[str], id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, path, status (ok, absent, invalid), kind and value of what each path leads to in each document, from one parse."""
    steps = [(path, jt.path_steps(path)) for path in paths]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in _texts([batch]):
                try:
                    found = jt.parse(text)
                except jt.JsonError:
                    rows += [(doc, path, "invalid", None, None) for path in paths]
                    continue
                for path, way in steps:
                    at = jt.find(text, found, way)
                    rows.append((doc, path, "absent", None, None) if at < 0 else (doc, path, "ok", found[at].kind, _utf8(jt.shown(text, found[at]))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["doc_id", "path", "status", "kind", "value"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, path string, status string, kind string, value string")


def query(docs: DataFrame, path: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, status (ok, absent, invalid), kind and value of what ``path`` leads to in each document."""
    return query_all(docs, [path], id_col, content_col).drop("path")


def members(tapes: DataFrame, parent: int = 0) -> DataFrame:
    """The pairs of the container at ``parent`` in order, repeated keys and all: doc_id, doc_key, ordinal, key, kind, lexeme, value."""
    return tapes.filter((F.col("parent") == parent) & ~F.col("is_key")).select(*DOC, "ordinal", "key", "kind", "lexeme", "value")


def first_member(tapes: DataFrame, key: str, parent: int = 0) -> DataFrame:
    """The first pair with ``key`` of each document."""
    found = members(tapes, parent).filter(F.col("key") == key)
    return found.groupBy(*DOC).agg(*(F.min_by(c, "ordinal").alias(c) for c in ("kind", "lexeme", "value")))


def kind_counts(tapes: DataFrame) -> DataFrame:
    """How many entries of each kind there are; keys count as strings."""
    return tapes.groupBy("kind").agg(F.count("*").alias("n"))


def duplicate_keys(tapes: DataFrame) -> DataFrame:
    """doc_id, doc_key, parent, key, n of keys that an object has more than once."""
    keys = tapes.filter("not is_key and key is not null")
    return keys.groupBy(*DOC, "parent", "key").agg(F.count("*").alias("n")).filter("n > 1")


def get_int(lexeme: str = "lexeme", kind: str = "kind", default: int = 0):  # noqa: ANN201
    """An integer value, ``default`` for anything else; out of the range of a long is ``default`` too."""
    return F.coalesce(F.when(F.col(kind) == "int", F.col(lexeme).try_cast("long")), F.lit(default).cast("long"))


def pairs_json(tapes: DataFrame) -> DataFrame:
    """doc_id, doc_key and the document's members as a JSON array of {key, kind, lexeme}, in order and with duplicates."""
    rows = members(tapes).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("ordinal", "key", "kind", "lexeme"))).alias("m"))
    return rows.select(*DOC, F.to_json(F.transform("m", lambda x: F.struct(x["key"].alias("key"), x["kind"].alias("kind"), x["lexeme"].alias("lexeme")))).alias("pairs"))


KINDS = ("object", "array", "string", "int", "float", "true", "false", "null")


def digest(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, a count for each kind, string_hash and int_sum of every valid document.

    ``string_hash`` is the FNV-1a of all decoded strings in order, keys among
    them, each followed by a zero byte; ``int_sum`` wraps at 64 bits.
    """
    from .gates import fnv1a

    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in _texts([batch]):
                try:
                    found = jt.parse(text)
                except jt.JsonError:
                    continue
                counts = [sum(e.kind == k for e in found) for k in KINDS]
                strings = b"".join(jt.decoded(text, e) + b"\0" for e in found if e.kind == "string")
                total = sum(int(jt.lexeme(text, e)) for e in found if e.kind == "int")
                rows.append((doc, *counts, f"{fnv1a(strings):016x}", (total + (1 << 63)) % (1 << 64) - (1 << 63)))
            if rows:
                types = [pa.int64(), *[pa.int64()] * len(KINDS), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", *names, "string_hash", "int_sum"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", string_hash string, int_sum long")
