"""The tree artifact: node tables to and from s-expression text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialects.specs import dialect
from ..operators.nodes import document_keys

# The header directives and the characters that strings escape.
MAGIC = "(.aif27)\n"
ESCAPED = "()[]{}~#'\"\\:@"
_ESCAPE = re.compile(rf"[\x00-\x1f{re.escape(ESCAPED)}]")
_EVENT = re.compile(r'[ \t\r\n]+|\((?P<tag>[^\s()"]*)|(?P<close>\))|"(?P<text>[^"]*)"?|(?P<other>[^\s()"]+)')
_UNESCAPE = re.compile(r"\\([0-9A-Fa-f]{2})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"\\{ord(m[0]):02X}", text)


def unescape(text: str) -> str:
    """A malformed escape keeps its backslash."""
    return _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), text)


def write_tree(name: str, vendor: str, nodes: Iterable[tuple[int, str, bytes | None, int, int]]) -> bytes:
    """The artifact of nodes (end_id, tag, raw, line, col) in document order."""
    out, open_ends = [f'{MAGIC}(.vendor "{escape(vendor)}")\n(.dialect "{escape(name)}")\n'], []
    for number, (end, tag, raw, line, col) in enumerate(nodes):
        while open_ends and open_ends[-1] <= number:
            open_ends.pop()
            out.append(")")
        out.append(f"({tag}" + (f"@{col},{line}" if end > number + 1 else ""))
        if raw is not None:
            out.append(f' "{escape(raw.decode("latin-1"))}"')
        open_ends.append(end)
    out.append(")" * len(open_ends))
    return "".join(out).encode("latin-1")


def read_events(text: str) -> Iterator[tuple[str, str]]:
    """(kind, value) events: open with a tag, close, text, other; suffixes of a tag are dropped."""
    for m in _EVENT.finditer(text):
        if m["tag"] is not None:
            yield "open", re.split(r"[@~#]", m["tag"], maxsplit=1)[0]
        elif m["close"]:
            yield "close", ""
        elif m["text"] is not None:
            yield "text", unescape(m["text"])
        elif m["other"]:
            yield "other", m["other"]


def artifacts(nodes: DataFrame, which: str, vendor: str = "treeloom") -> DataFrame:
    """doc_id, doc_key and artifact (bytes) of each document of a node table."""
    name = dialect(which).name
    rows = nodes.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("node_id", "end_id", "tag", "raw", "line", "col"))).alias("nodes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [write_tree(name, vendor, ((n["end_id"], n["tag"], n["raw"], n["line"], n["col"]) for n in x)) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "doc_key", "artifact"])

    return rows.mapInArrow(run, "doc_id long, doc_key long, artifact binary")


_READ = "doc_id long, doc_key long, node_id int, parent_id int, end_id int, depth int, tag string, raw binary"


def read_artifacts(artifacts: DataFrame, id_col: str = "doc_id", artifact_col: str = "artifact") -> DataFrame:
    """The node table of artifacts, without positions; directives are left out and of several strings the first counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = document_keys()
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = next(keys)
                rows: list[list] = []
                stack: list[int] = []
                for kind, value in read_events((content or b"").decode("latin-1")):
                    if kind == "open":
                        number = -1
                        if not value.startswith("."):
                            number = len(rows)
                            rows.append([doc, key, number, stack[-1] if stack else -1, number + 1, len(stack), value, None])
                        stack.append(number)
                    elif kind == "close" and stack:
                        number = stack.pop()
                        if number >= 0:
                            rows[number][4] = len(rows)
                    elif kind == "text" and stack and stack[-1] >= 0 and rows[stack[-1]][7] is None:
                        rows[stack[-1]][7] = value.encode("latin-1")
                for number in stack:
                    if number >= 0:
                        rows[number][4] = len(rows)
                if rows:
                    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string(), pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return artifacts.select(F.col(id_col).cast("long"), F.col(artifact_col).cast("binary")).mapInArrow(run, _READ)


def dialect_of(artifact: Column) -> Column:
    """Dialect name in an artifact's header; empty without one."""
    return F.regexp_extract(artifact.cast("string"), r'^\s*(?:\(\.[^)]*\)\s*)*?\(\.dialect "([^"]*)"', 1)


def canonical(artifact: Column) -> Column:
    """An artifact's text without what two writers of one tree may differ in: positions and comments of tags, vendor, format version.

    Strings have no bracket of their own, so a bracket always begins a node.
    """
    text = F.regexp_replace(artifact.cast("string"), r"\((\.?[^\s()\"@~#]*)[@~#][^\s()\"]*", "($1")
    text = F.regexp_replace(text, r'\(\.vendor "[^"]*"\)', '(.vendor "")')
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*\(\.[a-z]+\d+\)", "(.tree)"), r"\s+", " "))
