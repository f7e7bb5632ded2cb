"""Benchmark decontamination over an FM-index of each training shard.

A shard is what a task reads at a time, cut by bytes.  Its words become
symbols: those that a benchmark has, and one terminator for any other.  All
windows of the benchmark are searched backwards at once through the ranks of a
wavelet matrix, occurrences are located by sampled suffix positions, and the
spans of a document are merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, text_of, written
from .suffixes import FmIndex

WINDOW = 10
#: Bytes of text in a shard, and of benchmark text in a block.
SHARD_BYTES, BLOCK_BYTES = 6 << 20, 8 << 20
#: Blocks that are held at a time, by the driver and by a task.
BLOCKS_PER_PASS = 2
#: Upper case to lower, what is in no word to spaces.
WORDS = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 if i < 128 else i for i in range(256))
WORD = re.compile(rb"[^ ]+")
_PIECE = 1 << 20


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, long texts in several lists."""
    data = text.encode("utf-8", "replace").translate(WORDS)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + _PIECE) if len(data) > at + _PIECE else -1
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


@dataclass
class Block:
    """A block of benchmark items: its words, and its windows by length with the items that have them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def make_block(items: list[tuple[str, str]], window: int = WINDOW) -> Block:
    """The block of (item_id, text) rows; an item without words has no window."""
    block, found = Block(), {}
    for item, text in items:
        codes = [block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for part in words_of(text or "") for w in part]
        size = min(window, len(codes))
        for i in range(len(codes) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(codes[i : i + size]), set()).add(item)
    for size, windows in found.items():
        block.windows[size] = np.array(list(windows), np.int64)
        block.items[size] = [tuple(sorted(x)) for x in windows.values()]
    return block


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``, each small enough to send to every task."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if row[1] is None:
            continue
        held.append((row[0] if row[0] is not None else "null", row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield make_block(held, window)
            held, size = [], 0
    if held:
        yield make_block(held, window)


def search(block: Block, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Of each text: its number of words, the merged spans of words that windows cover, and the items they are of."""
    get, counts, kept, at, owner, offset = block.vocabulary.get, [], [], 0, [], []
    least = max(1, block.shortest)
    for i, text in enumerate(texts):
        parts = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in words_of(text)]
        codes = np.concatenate([*parts, np.zeros(1, np.int32)])
        counts.append(len(codes) - 1)
        # Runs of benchmark words that are too short for any window are left out of the index.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes > 0]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        for a, b in zip(starts[stops - starts >= least], stops[stops - starts >= least], strict=True):
            kept.append(codes[a : b + 1])
            owner.append(i)
            offset.append((at, a))
            at += b + 1 - a
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if kept:
        index = FmIndex(np.concatenate(kept))
        begin, shift = (np.array(x) for x in zip(*offset, strict=True))
        owners = np.array(owner)
        for size, windows in block.windows.items():
            low, high = index.find(windows)
            many = high - low
            which = np.repeat(np.arange(len(windows)), many)
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(which))
            place = index.locate(rows)
            run = np.searchsorted(begin, place, "right") - 1
            doc, word = owners[run], place - begin[run] + shift[run]
            order = np.lexsort((word, doc))
            for d, w in zip(doc[order].tolist(), word[order].tolist(), strict=True):
                spans[d].append((w, w + size))
            for d, k in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d].update(block.items[size][k])
    return [(n, merge(s), x) for n, s, x in zip(counts, spans, items, strict=True)]


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _shards(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about SHARD_BYTES of text, and their texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SHARD_BYTES or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


_FOUND_SQL = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def passes(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[Block]]:
    """The benchmark's blocks, as many at a time as one pass over the documents searches."""
    blocks = blocks_of(benchmark, window)
    while some := list(islice(blocks, BLOCKS_PER_PASS)):
        yield some


def _search_step(spark: SparkSession, blocks: list[Block], text_at: int, found_at: int, open_at: int | None = None):  # noqa: ANN202
    """A map that adds what ``blocks`` find to the column of (n_words, spans, items) of rows, or of rows that are open."""
    held = [spark.sparkContext.broadcast(b) for b in blocks]  # BLOCKS_PER_PASS times about BLOCK_BYTES of text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _shards(batches, text_at):
            use = range(len(texts)) if open_at is None else np.flatnonzero(part.column(open_at).to_numpy(zero_copy_only=False)).tolist()
            rows = [x if x else {"n_words": 0, "spans": [], "items": []} for x in part.column(found_at).to_pylist()]
            for block in held:
                for i, (n, new, names) in zip(use, search(block.value, [texts[i] for i in use]), strict=True):
                    spans = merge([(x["start"], x["stop"]) for x in rows[i]["spans"]] + new)
                    rows[i] = {"n_words": n, "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted({*rows[i]["items"], *names})}
            yield part.set_column(found_at, part.schema.names[found_at], pa.array(rows, _FOUND))

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, merged spans of hit words (start, stop) and item ids of each row.

    A benchmark of more than BLOCKS_PER_PASS blocks goes through in passes, each written before the next.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.lit(None).cast(_FOUND_SQL).alias("found"))
    groups = passes(benchmark, window)
    found = found.mapInArrow(_search_step(spark, next(groups, [Block()]), 1, 2), found.schema)
    path = None
    for blocks in groups:
        last, (found, path) = path, written(found, "found")
        if last:
            drop_written(spark, last)
        found = found.mapInArrow(_search_step(spark, blocks, 1, 2), found.schema)
    return found.select("doc_id", "text", "found.n_words", "found.spans", "found.items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each whole text.

    A null text has no words.  A null item text has no window, a null item_id
    is named ``null``.  Items that share a window are all counted.  Repeated
    rows are judged each; other columns are not read; no rows give no rows, and
    without a benchmark nothing is hit.
    """
    found = find_spans(docs, benchmark, window, id_col, text_col).drop("text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its words in ``spans`` and what stands between them."""
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(data.translate(WORDS))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, the hit words cut from its texts.

    What a cut brings together is searched again, until no window is left.
    Texts without a hit, nulls among them, stay as they are.
    A benchmark of more than BLOCKS_PER_PASS blocks goes through in passes.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    groups = passes(benchmark, window)
    first, more = next(groups, None), next(groups, None)
    if first is None:
        return docs
    if more is not None:
        return _in_passes(docs, benchmark, window, at)
    blocks = [spark.sparkContext.broadcast(b) for b in first]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _shards(batches, at):
            open_at, changed = list(range(len(texts))), set()
            while open_at:
                hit: dict[int, list] = {}
                for block in blocks:
                    for i, (_, spans, _) in zip(open_at, search(block.value, [texts[i] for i in open_at]), strict=True):
                        if spans:
                            hit[i] = merge(hit.get(i, []) + spans)
                for i, spans in hit.items():
                    texts[i] = cut(texts[i], spans)
                open_at = sorted(hit)
                changed |= hit.keys()
            column = part.column(at)
            if changed:
                old = column.to_pylist()
                column = pa.array([texts[i] if i in changed else old[i] for i in range(len(texts))], column.type)
            yield part.set_column(at, part.schema.names[at], column)

    return docs.mapInArrow(run, docs.schema)


def _in_passes(docs: DataFrame, benchmark: DataFrame, window: int, at: int) -> DataFrame:
    """Search all blocks in passes and then cut, over again until no text is cut; each pass is written before the next."""
    spark, n = docs.sparkSession, len(docs.columns)
    found, still = "found", "open"
    while found in docs.columns or still in docs.columns:
        found, still = found + "_", still + "_"
    rows, path = docs.withColumn(found, F.lit(None).cast(_FOUND_SQL)).withColumn(still, F.lit(True)), None

    def cut_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["start"], s["stop"]) for s in x["spans"]] if x else [] for x in batch.column(n).to_pylist()]
            texts = [cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            batch = batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.column(at).type))
            batch = batch.set_column(n, found, pa.nulls(len(batch), _FOUND))
            yield batch.set_column(n + 1, still, pa.array([bool(s) for s in spans]))

    while True:
        for blocks in passes(benchmark, window):
            last, (rows, path) = path, written(rows.mapInArrow(_search_step(spark, blocks, at, n, n + 1), rows.schema), "searched")
            if last:
                drop_written(spark, last)
        last, (rows, path) = path, written(rows.mapInArrow(cut_rows, rows.schema), "cut")
        drop_written(spark, last)
        if rows.filter(still).isEmpty():
            return rows.select(docs.columns)
