"""Quality gates as queries: identity of tokens, round trips, shapes, truncations, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialects import html
from ..dialects.specs import OPAQUE, PUNCT, dialect, node_spec_rows
from ..dialects.tree import Tree
from .nodes import mapped
from .tree import count_tag, max_nesting

#: Prefixes of a document, and the largest document, of the truncation gate, where it is not asked for all.
SAMPLES, LARGEST = 128, 262_144
#: Parsers, and what makes their trees of many prefixes of a text without starting over; the same of all prefixes.
RESUMED = {html.parse: html.prefixes}
GROWING = {html.parse: html.growing}
#: Nodes that may be rendered again with the next prefix.
_AGAIN = 8


def _content(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("content"))


def identity(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, same: whether the tokens of a document, one behind the other, are the document; a row for each row of ``docs``."""
    tokens = dialect(which).tokens
    if tokens is None:
        raise ValueError(f"{which} is read line by line and has no tokens")

    def same(content: bytes) -> bool:
        text = content.decode("latin-1")
        return "".join(text[a:b] for _, a, b in tokens(text)) == text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(map(same, batch.column(1).to_pylist()), pa.bool_())], names=["doc_id", "same"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, same boolean")


def _rendered(which: str) -> Callable[..., str]:
    """The text, a character a byte, that a tree or the nodes of a range stand for."""
    command = dialect(which).command
    literals = PUNCT.get(command, {})
    opaque = frozenset(OPAQUE.get(command, "").split())
    return lambda tree, start=0, stop=None: tree.rendered(literals, opaque, start, stop)


def judge(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, same, first_difference and undeclared of each row of ``docs``, null and repeated ids among them.

    ``same``: rendering the document's tree gives the document;
    ``first_difference`` is a byte offset, null where there is none; ``undeclared`` are the tags
    that the dialect does not declare.  Documents are parsed once and do not move.
    """
    rendered, declared = _rendered(which), frozenset(tag for name, tag, _, _ in node_spec_rows() if name == dialect(which).name)

    def of(tree: Tree) -> tuple[bool, int | None, list[str]]:
        back, content = rendered(tree), tree.text
        differ = None if back == content else next((i for i, (x, y) in enumerate(zip(back, content, strict=False)) if x != y), min(len(back), len(content)))
        return differ is None, differ, sorted(set(tree.tags) - declared)

    return mapped(docs, which, of, "same boolean, first_difference int, undeclared array<string>", [pa.bool_(), pa.int32(), pa.list_(pa.string())], id_col, content_col)


def round_trip(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, same, first_difference of :func:`judge`."""
    return judge(docs, which, id_col, content_col).drop("undeclared")


def first_difference(a: Column, b: Column) -> Column:
    """First byte offset at which two byte strings differ, the length of the shorter if one begins the other, null if equal."""
    at = F.when(a == b, F.lit(None).cast("int")).otherwise(F.least(F.octet_length(a), F.octet_length(b)))
    search = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.octet_length(a), F.octet_length(b))))
    differ = F.filter(search, lambda i: F.substring(F.hex(a), i * 2 - 1, F.lit(2)) != F.substring(F.hex(b), i * 2 - 1, F.lit(2)))
    return F.when(a == b, at).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, at))


def excerpt(column: Column, at: Column, width: int = 40) -> Column:
    """Text around a place, control characters escaped."""
    part = F.substring(column, F.greatest(F.lit(1), at - width // 2 + 1), F.lit(width))
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        part = F.replace(part, F.lit(raw), F.lit(shown))
    return part


def _expected(found: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    wanted = expected.select("doc_id", F.col("want").cast("long").alias("want"))
    found = found.select(F.col("doc_id").alias("__id"), F.col(column).alias("n"))
    rows = wanted.join(found, wanted["doc_id"].eqNullSafe(found["__id"]), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "want")
    return rows.withColumn("holds", F.col("n") == F.col("want"))


def expect_count(nodes: DataFrame, tag: str, expected: DataFrame) -> DataFrame:
    """doc_id, n, want, holds for the wanted counts in ``expected`` (doc_id, want); a row for each document of that id."""
    return _expected(count_tag(nodes, tag), "n", expected)


def expect_nesting(nodes: DataFrame, tag: str, expected: DataFrame) -> DataFrame:
    """As :func:`expect_count`, of how deep ``tag`` stands in itself."""
    return _expected(max_nesting(nodes, tag), "depth", expected)


def failed_from(trees: Iterable[tuple[Tree, int]], text: str, cuts: Iterable[int], rendered: Callable[..., str]) -> int:
    """How many of the trees of growing prefixes do not render to their prefix; nodes that are kept are rendered once."""
    failed, nodes, at, same = 0, 0, 0, True
    for cut, (tree, kept) in zip(cuts, trees, strict=True):
        if kept > nodes:
            part = rendered(tree, nodes, kept)
            same = same and text.startswith(part, at)
            nodes, at = kept, at + len(part)
        failed += not (same and at <= cut and rendered(tree, kept) == text[at:cut])
    return failed


def failed_growing(runs: Iterable[tuple[Tree, int, int, int]], text: str, alone: Callable[[str], bool], rendered: Callable[..., str]) -> int:
    """How many of all prefixes do not render to themselves, from trees of runs of prefixes as :func:`html.growing` makes them.

    The prefixes of a run have the same nodes and lack as many bytes of the last
    leaf as of the text, so all hold if the longest does.  Of a run that does
    not, each is asked for ``alone``.
    """
    failed, nodes, at = 0, 0, 0
    for tree, kept, first, last in runs:
        whole = kept == len(tree.ends)
        if kept > nodes + _AGAIN and not whole:
            part = rendered(tree, nodes, kept)
            if text.startswith(part, at, last):
                nodes, at = kept, at + len(part)
        if rendered(tree, nodes) != text[at:last]:
            failed += sum(not alone(text[:n]) for n in range(first, last + 1))
        elif whole:
            nodes, at = kept, last
    return failed


def truncations(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content", samples: int | None = SAMPLES, largest: int | None = LARGEST) -> DataFrame:
    """doc_id, prefixes, failed, skipped: prefixes of each document are parsed and rendered.

    There are from one more to twice as many as ``samples``, evenly spaced, or
    all of a short document; without ``samples`` there are those of every size.
    Documents above ``largest`` bytes, if there is such a size, are skipped, and
    say so.  Prefixes are cut and checked where the document is; none crosses a
    shuffle.  A parser of RESUMED or GROWING does not parse again what a prefix
    shares with the one before.
    """
    parse, rendered = dialect(which).parse, _rendered(which)
    resumed, growing = RESUMED.get(parse), GROWING.get(parse)

    def failures(text: str, cuts: range) -> int:
        if growing and samples is None:
            return failed_growing(growing(text), text, lambda prefix: rendered(parse(prefix)) == prefix, rendered)
        return failed_from(resumed(text, cuts), text, cuts, rendered) if resumed else sum(rendered(parse(text[:n])) != text[:n] for n in cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = content.decode("latin-1")
                if largest is not None and len(text) > largest:
                    rows.append((doc, 0, 0, True))
                    continue
                cuts = range(0, len(text) + 1, max(1, len(text) // samples) if samples is not None else 1)
                rows.append((doc, len(cuts), failures(text, cuts), False))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "prefixes", "failed", "skipped"])

    return _content(docs, id_col, content_col).mapInArrow(run, "doc_id long, prefixes long, failed long, skipped boolean")


def report(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """One row: documents, those that do not round-trip, those with undeclared tags."""
    found = judge(docs, which, id_col, content_col)
    return found.agg(F.lit(dialect(which).name).alias("dialect"), F.count("*").alias("checked"), F.count_if(~F.col("same")).alias("broken"), F.count_if(F.size("undeclared") > 0).alias("undeclared"))


def fnv1a(data: bytes, start: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a."""
    for byte in data:
        start = ((start ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return start
