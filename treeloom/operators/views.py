"""Decoded views: stylesheet declarations, raw element text, attributes, configuration entries.

Each is one parse.  What a row says of the nodes around it is computed where the document is parsed, so nothing is joined
or shuffled, and ids may be null or repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialects import context, css
from ..dialects.tree import Tree
from .nodes import parse_nodes

_QUOTED = r"(?s)^([\"'])(.*)\1$"


def collapsed(column: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(column, "[ \t\n\r\f]+", " "))


def css_selectors(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, doc_key, node_id, selector of every rule that has one."""
    rules = parse_nodes(docs, "css", id_col, content_col, tags=("rule",), carry={"selector": ("string", context.joined("rule", "sel"))})
    return rules.filter("selector <> ''").select("doc_id", "doc_key", "node_id", "selector")


def css_declarations(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, doc_key, node_id, selector, at_rule, prop, value, line of every declaration.

    Selector and at-rule are those of the innermost rule and at-rule around the
    declaration, empty without one; at-rules keep their ``@``.
    """
    carry = {
        "selector": ("string", context.joined("rule", "sel")), "at_rule": ("string", context.first_child("atrule", "name")),
        "prop": ("string", context.first_child("decl", "prop", trim=True)), "value": ("string", context.joined("decl", "val")),
    }
    found = parse_nodes(docs, "css", id_col, content_col, tags=("decl",), carry=carry)
    return found.select("doc_id", "doc_key", "node_id", "selector", F.coalesce("at_rule", F.lit("")).alias("at_rule"), "prop", "value", "line")


def _running_declarations(tree: Tree) -> Iterator[tuple[int, str, str, str, str]]:
    """(node, selector, at-rules, property, value) by what was last seen rather than by what is around."""
    raws = [(r or b"").decode("utf-8", "replace") for r in tree.raws()]
    squeeze = lambda text: " ".join(re.sub("[ \t\n\r\f]+", " ", text).strip(" \t\n\r").split(" "))
    selector = at_rules = ""
    inner = -1  # end of the at-rule that was opened last
    for node, tag in enumerate(tree.tags):
        if 0 <= inner <= node:
            at_rules, inner = "", -1
        if tag == "atrule":
            inner = tree.ends[node]
        elif tag == "name" and inner >= 0:
            at_rules += raws[node]
        elif tag == "sel":
            selector = squeeze("".join(raws[i] for i in range(node, tree.ends[node]) if tree.tags[i] != "comment"))
        elif tag == "decl":
            inside = range(node + 1, tree.ends[node])
            name = next((raws[i] for i in inside if tree.tags[i] == "prop"), "").strip(" \t\n\r")
            value = next((i for i in inside if tree.tags[i] == "val"), -1)
            text = "" if value < 0 else squeeze("".join(raws[i] for i in range(value, tree.ends[value]) if tree.tags[i] != "comment"))
            yield node, selector, at_rules, name, text


def css_declarations_running(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """As :func:`css_declarations`, but by a running scan, for results that must match one.

    A declaration outside a rule has the selector that was seen last; names of
    nested at-rules are joined, and all are forgotten when the innermost closes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *found) for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for found in _running_declarations(css.parse((content or b"").decode("latin-1")))]
            if rows:
                types = [pa.int64(), pa.int32(), *[pa.string()] * 4]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "node_id", "selector", "at_rule", "prop", "value"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(run, "doc_id long, node_id int, selector string, at_rule string, prop string, value string")


def raw_text_of(docs: DataFrame, name: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, doc_key, node_id, content: the text that follows each start tag of ``name`` before any other tag or text."""
    texts = parse_nodes(docs, "html", id_col, content_col, tags=("text",), carry={"after": ("string", context.after_start_tag)})
    return texts.filter(F.col("after") == name.lower()).select("doc_id", "doc_key", "node_id", F.decode("raw", "UTF-8").alias("content"))


def html_elements(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """The elements of pages as nodes, with their names in lower case as ``element``."""
    return parse_nodes(docs, "html", id_col, content_col, tags=("elem",), carry={"element": ("string", context.ELEMENT)})


def html_attributes(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, doc_key, node_id, element, attribute and value of every attribute; quotes of the value are dropped, names are in lower case."""
    carry = {
        "element": ("string", context.TAG_NAME), "attribute": ("string", context.first_child("attr", "aname", lower=True)),
        "value": ("string", context.first_child("attr", "aval")),
    }
    found = parse_nodes(docs, "html", id_col, content_col, tags=("attr",), carry=carry)
    return found.select("doc_id", "doc_key", "node_id", "element", "attribute", F.regexp_replace("value", _QUOTED, "$2").alias("value"))


def cfg_entries(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, doc_key, node_id, section, key, value of every entry; a matched pair of quotes is dropped from the value."""
    carry = {
        "section": ("string", context.first_child("section", "name")), "key": ("string", context.first_child("entry", "key")),
        "value": ("string", context.first_child("entry", "value")),
    }
    found = parse_nodes(docs, "cfg", id_col, content_col, tags=("entry",), carry=carry)
    return found.select("doc_id", "doc_key", "node_id", "section", "key", F.regexp_replace("value", '(?s)^"(.*)"$', "$1").alias("value"))


def identifier_entries(entries: DataFrame) -> DataFrame:
    """Entries whose key can be an identifier."""
    return entries.filter(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
