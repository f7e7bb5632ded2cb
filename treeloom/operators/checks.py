"""Literal checks: is a text of a dialect sound, and what is its first error.

A row comes out for each row that goes in, whatever its id, from one parse and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialects import context, css
from ..dialects.tree import Diagnostic, Positions, Tree
from .nodes import mapped
from .views import cfg_entries, identifier_entries


def _first_error(tree: Tree) -> Diagnostic | None:
    return next((d for d in tree.diagnostics if d.severity == "error"), None)


def literal_check(docs: DataFrame, which: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, sound, code, message, line, col: the first error that the parser met, nulls for a sound text."""

    def of(tree: Tree) -> tuple:
        error = _first_error(tree)
        if error is None:
            return True, None, None, None, None
        line, col = Positions(tree.text).of(np.array([error.at]))
        return False, error.code, error.message, int(line[0]), int(col[0])

    return mapped(docs, which, of, "sound boolean, code string, message string, line int, col int", [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()], id_col, content_col)


def _page(tree: Tree) -> tuple[str | None, list[bytes]]:
    """Code of a page's first error, and its style texts."""
    error, after = _first_error(tree), context.after_start_tag(tree)
    styles = [i for i, tag in enumerate(tree.tags) if tag == "text" and after(i) == "style"]
    return error and error.code, tree.raws(styles)


def _styles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first error of the first unsound style text of each page."""
    for batch in batches:
        errors = [next((e for raw in styles if (e := _first_error(css.parse(raw.decode("latin-1"))))), None) for styles in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([e and e.code for e in errors], pa.string())], names=["doc_id", "html_code", "css_code"])


def web_check(pages: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, sound, part (html or css), code: a page's own first error, else that of its first unsound style text.

    Scripts are not checked.
    """
    found = mapped(pages, "html", _page, "html_code string, styles array<binary>", [pa.string(), pa.list_(pa.binary())], id_col, content_col)
    both = found.mapInArrow(_styles, "doc_id long, html_code string, css_code string")
    part = F.when(F.col("html_code").isNotNull(), "html").when(F.col("css_code").isNotNull(), "css")
    return both.select("doc_id", part.isNull().alias("sound"), part.alias("part"), F.coalesce("html_code", "css_code").alias("code"))


def constants(configs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, key, value of the configuration entries that can be constants: keys shaped like identifiers, quotes dropped."""
    return identifier_entries(cfg_entries(configs, id_col, content_col)).select("doc_id", "key", "value")
