"""Removal of repeated passages over run-length indexes.

Equal texts are brought together first, and from then on a text stands for its
copies.  Every stretch of SHORT bytes is owned by its least k-gram hash, so equal
stretches, wherever they are, have the same owner; neighbouring starts with one
owner travel as a single super-window, with the bytes that the windows from
these starts reach.  What two super-windows of an owner share, other than by
chance, reaches half a stretch to one side of the k-gram at least; only those
that agree there need their bytes compared.  They go by owner into shards, and
each shard builds a run-compressed Burrows-Wheeler index and streams matching
statistics against it.  A super-window that occurs twice as a whole is repeated
without a comparison, and an owner with more super-windows than a shard may
hold has its windows counted one by one.

Two kinds of windows are looked for at once.  Those of LENGTH bytes are what is
removed.  A passage is a window that begins with a word and has at least
WORDS words and SHORT bytes, or LENGTH bytes where that is less.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, collected, drop_written, release, shared_path, text_of, written
from .suffixes import RunLengthIndex

#: Bytes of a window that is removed where it is repeated; words and least bytes of a passage.
LENGTH, WORDS, SHORT = 400, 51, 272
#: Bytes of the k-grams that own windows.
GRAM = 32
#: Bytes of text that are scanned at a time, and of super-windows in a shard's index.
SCAN_BYTES, INDEX_BYTES = 1 << 20, 1 << 19
#: Owners with more different super-windows than this have their windows counted one by one.
HOT_OWNER = 2000
#: Owners with about so many are not brought together at all; they are found on one of so many super-windows.
LARGE_OWNER, LARGE_SHARE = 200_000, 64
_PLACE = (1 << 24) - 1
#: No hash: there is nothing that far on that side of an owner.  Where sides are not told apart, all agree.
NO_SIDE, ANY_SIDE = 0, 1
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WINDOW, PASSAGE, WHOLE = 0, 1, 2


def _gram_hashes(raw: bytes, n: int, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position."""
    padded = raw + b"\0" * (gram + 8)
    eight = np.ndarray((n,), "<u8", buffer=padded, strides=(1,)).copy()
    m = n - gram + 1

    def mixed(h: np.ndarray) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    if gram & (gram - 1) == 0 and gram >= 8:
        h, size = mixed(eight), 8
        while size < gram:
            h = mixed(h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:])
            size *= 2
        return h[:m]
    h = np.zeros(m, np.uint64)
    for start in range(0, gram, 8):
        part = eight[start : start + m]
        if gram - start < 8:
            part = part & ((np.uint64(1) << np.uint64(8 * (gram - start))) - np.uint64(1))
        h = mixed(h + part)
    return h


def super_windows(raw: bytes, sizes: np.ndarray, length: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-windows of texts that stand one behind the other in ``raw``, at most 2**24 bytes.

    Start, number of windows of ``length`` bytes, position of the owning k-gram,
    its hash, and the hashes of either side of it in one number.  The leftmost
    of equal least hashes owns a window; no window crosses texts.
    """
    n = len(raw)
    gram = min(GRAM, length)
    nothing = np.zeros(0, np.int64)
    if n < length:
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing
    h = _gram_hashes(raw, n, gram)
    value = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, size, starts = length - gram + 1, 1, n - length + 1
    while size * 2 <= width:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    value = np.minimum(value[:starts], value[width - size : width - size + starts])
    owner = (value & np.uint64(_PLACE)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    fits = np.asarray(sizes) >= length
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, begins[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    inside = np.cumsum(inside)[:starts] > 0
    cut = np.ones(starts + 1, bool)
    cut[1:starts] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    cut[begins[fits]] = True
    edges = np.flatnonzero(cut)
    first, count = edges[:-1], np.diff(edges)
    use = inside[first]
    first, count = first[use], count[use]
    owner = owner[first]
    end = ends[np.searchsorted(ends, first, "right")]
    return first, count, owner, h[owner], _sides(h, first, owner, end, gram, (length - gram) // 2)


def _sides(h: np.ndarray, first: np.ndarray, owner: np.ndarray, end: np.ndarray, gram: int, side: int) -> np.ndarray:
    """Hashes of the ``side`` bytes before and after owners, where they are within super-window and text."""
    if side < gram:
        return np.full(len(first), ANY_SIDE << 32 | ANY_SIDE, np.int64)

    def hashed(begin: np.ndarray, known: np.ndarray) -> np.ndarray:
        at, got = np.where(known, begin, 0), np.zeros(len(begin), np.uint64)
        for step in [*range(0, side - gram, gram), side - gram]:
            got = got * np.uint64(0x9E3779B97F4A7C15) + h[at + step]
            got ^= got >> np.uint64(31)
        return np.where(known, (got >> np.uint64(33)).astype(np.int64) + 2, NO_SIDE)

    return hashed(owner - side, owner - side >= first) << 32 | hashed(owner + gram, owner + gram + side <= end)


def word_passages(data: np.ndarray, starts: np.ndarray, words: int, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin in strings that begin at ``starts``, which string each is of, and the bytes of the passage from there.

    A passage reaches the first byte of its last word, so its own bytes say how
    long it is.  Where the string has too few words left it is ``length``.
    """
    space = _SPACE[data]
    fresh = ~space
    fresh[1:] &= space[:-1]
    some = starts[starts < len(data)]
    fresh[some] = ~space[some]
    begins = np.flatnonzero(fresh)
    string = np.searchsorted(starts, begins, "right") - 1
    last = np.arange(len(begins)) + words - 1
    known = last < len(begins)
    last = np.minimum(last, len(begins) - 1)
    known &= string[last] == string
    return begins, string, np.where(known, np.clip(begins[last] + 1 - begins, short, length), length)


def unions(string: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each string, those that touch or overlap as one."""
    order = np.lexsort((low, string))
    string, low, high = string[order], low[order], high[order]
    if not len(low):
        return string, low, high
    wide = np.int64(high.max()) + 2
    reach = np.maximum.accumulate(high + string * wide)
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] + string[1:] * wide > reach[:-1]
    fresh[1:] |= string[1:] != string[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(low)) - 1
    return string[first], low[first], reach[last] - string[first] * wide


def _may_begin(data: bytes, at: int) -> bool:
    """Whether a word may begin at a position: nothing or white space is before it."""
    return at == 0 or data[at - 1] in b"\t\n\v\f\r "


_SW = "owner long, content long, sides long, h1 long, h2 long, copies long, start long, windows int, size int, own int"


def _scan(batches: Iterable[pa.RecordBatch], short: int, length: int) -> Iterator[pa.RecordBatch]:
    """Super-windows of the texts of a batch; long texts are scanned in parts that overlap by a window."""

    def rows(held: list[tuple[int, int, int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([t[5] for t in held], np.int64)
        first, count, owner, h, sides = super_windows(b"".join(t[3][t[4] : t[4] + t[5]] for t in held), sizes, short)
        if not len(first):
            return
        begins = np.cumsum(sizes) - sizes
        text = np.searchsorted(begins, first, "right") - 1
        starts = first - begins[text] + np.array([t[4] for t in held], np.int64)[text]
        size = np.minimum(count + length - 1, np.array([len(t[3]) for t in held], np.int64)[text] - starts)
        digest, whole = xxhash.xxh3_64_intdigest, [t[3] for t in held]
        content = np.fromiter((digest(whole[i][a : a + k], _may_begin(whole[i], a)) for i, a, k in zip(text.tolist(), starts.tolist(), size.tolist(), strict=True)), np.uint64, len(first))
        of_text = [pa.array(np.array([t[i] for t in held], np.int64)[text]) for i in range(3)]
        narrow = [pa.array(x.astype(np.int32)) for x in (count, size, owner - first)]
        columns = [pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array(sides), *of_text, pa.array(starts), *narrow]
        yield pa.record_batch(columns, names=[x.split()[0] for x in _SW.split(", ")])

    for batch in batches:
        held, size = [], 0
        for h1, h2, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(0, len(data) - short + 1, SCAN_BYTES):
                part = min(SCAN_BYTES + short - 1, len(data) - at)
                held.append((h1, h2, copies, data, at, part))
                size += part
                if size >= SCAN_BYTES:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)


def _combine(keys: int):  # noqa: ANN202
    """Rows of a batch that have their first ``keys`` columns, longs, in common as one, the last column summed up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [batch.column(i).to_numpy() for i in range(keys)]
            order = np.lexsort(by[::-1])
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in by])
            at = np.flatnonzero(fresh)
            counts = np.add.reduceat(batch.column(batch.num_columns - 1).to_numpy()[order], at) if len(at) else at
            one = batch.take(pa.array(order[at]))
            yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array(counts.astype(np.int64))], names=batch.schema.names)

    return run


_TEXTS = "h1 long, h2 long, content binary, copies long"


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text, of rows sorted by its digest."""
    held, copies = None, 0
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        counts = batch.column(3).to_pylist()
        done, sums = [], []
        for i, key in enumerate(keys):
            if held is not None and key == held[0]:
                copies += counts[i]
                continue
            if held is not None:
                done.append(held[1])
                sums.append(copies)
            held, copies = (key, batch.slice(i, 1)), counts[i]
        if done:
            yield _counted(pa.Table.from_batches(done).combine_chunks().to_batches()[0], sums)
    if held is not None:
        yield _counted(held[1], [copies])


def _counted(batch: pa.RecordBatch, copies: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copies, pa.int64())], names=batch.schema.names)


def distinct_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """h1, h2 (a digest), content (bytes) and copies of each text, laid out by digest; and the table's name and path.

    Copies are combined in each batch before they move, so a text that a third of all rows share moves a few times.
    What is joined with this table by digest moves to it; the texts do not move again.
    """
    spark = docs.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    rows = docs.select(*digest_of(text_col), text_of(text_col).cast("binary").alias("content"), F.lit(1).cast("long").alias("copies"))
    sorted_rows = rows.mapInArrow(_combine(2), _TEXTS).repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2")
    path = shared_path(spark, "texts")
    name = "texts_" + path.rpartition("-")[2]
    sorted_rows.mapInArrow(_unite, _TEXTS).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
    return spark.table(name), [name, path]


def digest_of(text_col: str) -> tuple[Column, Column]:
    """128 bits of a text in two columns, a null text as an empty one."""
    text = text_of(text_col)
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("h2")


def _wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, int, dict, bytes, bool]]]:
    """Of each batch: texts by digest with their wanted super-windows, the bytes of these, and whether a word may begin with the first."""
    for batch in batches:

        def found(batch: pa.RecordBatch = batch) -> Iterator[tuple[int, int, dict, bytes, bool]]:
            for h1, h2, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    at = w["start"]
                    yield h1, h2, w, data[at : at + w["size"]], _may_begin(data, at)

        yield found()


_PIECES = "owner long, n long, h1 long, h2 long, start long, windows int, own int, fresh boolean, piece binary"
_PIECE_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


@dataclass
class Piece:
    owner: int
    n: int
    h1: int
    h2: int
    start: int
    windows: int
    own: int  # where the owner is in ``data``
    fresh: bool
    data: bytes


def _cut_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted super-windows."""

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    for found in _wanted(batches):
        out, size = [], 0
        for h1, h2, w, piece, fresh in found:
            out.append((w["owner"], w["n"], h1, h2, w["start"], w["windows"], w["own"], fresh, piece))
            size += len(piece)
            if size >= 4 << 20:
                yield pieces(out)
                out, size = [], 0
        if out:
            yield pieces(out)


_MARKS = "h1 long, h2 long, kind int, low long, high long"


def _passages(pieces: list[Piece], words: int, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages that begin at the windows of super-windows: which one's, from where to where, and a digest of owner and bytes.

    Equal passages have one owner, and it stands at the same place of them.
    """
    sizes = np.array([len(x.data) for x in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(x.data for x in pieces), np.uint8)
    at, string, need = word_passages(data, begins, words, short, length)
    place = at - begins[string]
    use = ((place > 0) | np.array([x.fresh for x in pieces])[string]) & (place < np.array([x.windows for x in pieces])[string]) & (place + need <= sizes[string])
    string, low, high = string[use], place[use], place[use] + need[use]
    digest = xxhash.xxh3_64_intdigest
    key = np.fromiter((digest(pieces[i].data[a:b], pieces[i].owner & (1 << 64) - 1) for i, a, b in zip(string.tolist(), low.tolist(), high.tolist(), strict=True)), np.uint64, len(string))
    return string, low, high, key


def _alike(pieces: list[Piece], short: int, length: int) -> list[Piece]:
    """Pieces that may share a window of ``length`` bytes with another one: they agree on half of it before or after the owner."""
    gram = min(GRAM, short)
    side, digest = (length - gram) // 2, xxhash.xxh3_64_intdigest
    if side < gram:
        return pieces
    seen: Counter = Counter()
    keys = []
    for x in pieces:
        held = []
        if x.own >= side:
            held.append((x.owner, 0, digest(x.data[x.own - side : x.own])))
        if x.own + gram + side <= len(x.data):
            held.append((x.owner, 1, digest(x.data[x.own + gram : x.own + gram + side])))
        seen.update(held)
        keys.append(held)
    return [x for x, held in zip(pieces, keys, strict=True) if any(seen[k] > 1 for k in held)]


def _index(length: int, words: int, short: int):  # noqa: ANN202
    """Index the pieces of a shard and mark the byte ranges that repeated windows and passages cover."""

    def marks(pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
        alike = _alike(pieces, short, length)
        once = np.array([i for i, x in enumerate(alike) if x.n == 1], np.int64)
        if len(once):
            index = RunLengthIndex([x.data for x in alike])
            windows = [(which[hit], place[hit]) for which, place, longest in index.statistics(once) if (hit := longest >= length).any()]
            if windows:
                string, low = (np.concatenate(x) for x in zip(*windows, strict=True))
                yield spans(alike, WINDOW, string, low, low + length)
        times = np.array([x.n for x in pieces])
        string, low, high, key = _passages(pieces, words, short, length)
        _, at = np.unique(key, return_inverse=True)
        hit = (times[string] == 1) & (np.bincount(at, times[string])[at] > 1)
        if hit.any():
            yield spans(pieces, PASSAGE, string[hit], low[hit], high[hit])

    def spans(pieces: list[Piece], kind: int, string: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        string, low, high = unions(string, low, high)
        of = [pieces[i] for i in string.tolist()]
        start = np.array([x.start for x in of])
        columns = [pa.array([x.h1 for x in of], pa.int64()), pa.array([x.h2 for x in of], pa.int64()), pa.array(np.full(len(of), kind, np.int32)), pa.array(low + start), pa.array(high + start)]
        return pa.record_batch(columns, names=["h1", "h2", "kind", "low", "high"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Piece] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and row[0] != held[-1].owner:
                    yield from marks(held)
                    held, size = [], 0
                held.append(Piece(*row))
                size += len(row[-1])
        if held:
            yield from marks(held)

    return run


_HOT = "key binary, n long, h1 long, h2 long, kind int, low long, high long"


def _hot_windows(length: int, words: int, short: int):  # noqa: ANN202
    """A row for each window and each passage of hot super-windows, keyed by a digest of its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for found in _wanted(batches):
            out: list[tuple] = []
            for h1, h2, w, piece, fresh in found:
                data = np.frombuffer(piece, np.uint8)
                start, begins, _, need = w["start"], *word_passages(data, np.zeros(1, np.int64), words, short, length)
                for at in range(min(w["windows"], len(piece) - length + 1)):
                    out.append((digest(piece[at : at + length], WINDOW), w["n"], h1, h2, WINDOW, start + at, start + at + length))
                for at, size in zip(begins.tolist(), need.tolist(), strict=True):
                    if at < w["windows"] and at + size <= len(piece) and (at or fresh):
                        out.append((digest(piece[at : at + size], PASSAGE), w["n"], h1, h2, PASSAGE, start + at, start + at + size))
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _HOT.split(", ")])

    return run


def _equal(narrow: DataFrame) -> DataFrame:
    """owner, content, sides, n of different super-windows; equal ones of a batch are combined before they move."""
    return narrow.mapInArrow(_combine(2), "owner long, content long, sides long, n long")


def _sided(equal: DataFrame) -> DataFrame:
    return equal.withColumn("left", F.shiftright("sides", 32)).withColumn("right", F.col("sides").bitwiseAND(F.lit((1 << 32) - 1)))


def _near(narrow: DataFrame) -> DataFrame:
    """owner, content, n, near and hot of super-windows that are repeated or may share something with another one of their owner."""
    equal = _equal(narrow).repartition("owner").groupBy("owner", "content").agg(F.sum("n").alias("n"), F.min("sides").alias("sides"))
    of_owner = Window.partitionBy("owner")
    sided = _sided(equal.withColumn("kinds", F.count("*").over(of_owner)).filter("n > 1 or kinds > 1"))
    for side in ("left", "right"):
        alike = F.count("*").over(Window.partitionBy("owner", side)) > 1
        sided = sided.withColumn(f"{side}s", (F.col("kinds") > 1) & (F.col(side) != NO_SIDE) & alike)
    near = sided.withColumn("near", F.col("lefts") | F.col("rights")).filter("n > 1 or near")
    near = near.withColumn("hot", F.sum(F.col("near").cast("int")).over(of_owner) > HOT_OWNER).withColumn("new", F.min(F.when(F.col("near"), F.col("n"))).over(of_owner) == 1)
    near = near.withColumn("near", F.col("near") & F.col("new")).filter("n > 1 or near")  # where all are repeated there is nothing to compare
    return near.select("owner", "content", "n", "near", "hot")


def _near_of_large(narrow: DataFrame) -> DataFrame:
    """The same for owners of any number of super-windows, which spread over tasks by content and by side; all count as hot."""
    equal = _sided(_equal(narrow).groupBy("owner", "content").agg(F.sum("n").alias("n"), F.min("sides").alias("sides")))
    near = equal
    for side in ("left", "right"):
        alike = equal.filter(F.col(side) != NO_SIDE).groupBy("owner", side).count().filter("count > 1").select("owner", side, F.lit(True).alias(f"{side}s"))
        near = near.join(alike, ["owner", side], "left")
    near = near.withColumn("near", F.coalesce("lefts", "rights", F.lit(False))).filter("n > 1 or near")
    return near.select("owner", "content", "n", "near", F.col("near").alias("hot"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, words: int = WORDS, short: int = SHORT) -> tuple[DataFrame, str]:
    """h1, h2 and spans (array of kind, low, high) of the texts, as :func:`distinct_texts` gives them, with repeated windows or passages.

    ``low`` and ``high`` are byte offsets; spans may overlap and are in no order.
    A span of kind WINDOW is covered by repeated windows, one of kind PASSAGE by
    repeated passages, and one of kind WHOLE occurs elsewhere as it is.  Texts
    that have copies are repeated as a whole and need no span.  The table is a
    checkpoint, and its path comes with it.
    """
    spark = texts.sparkSession
    short = min(short, length)
    with collected() as made:
        scanned = checkpoint(texts.select("h1", "h2", "copies", "content").mapInArrow(lambda batches: _scan(batches, short, length), _SW), "windows")

        # Owners with very many super-windows, found on a share of these, are kept out of what one task does for an owner.
        counted = scanned.filter(F.pmod("content", F.lit(LARGE_SHARE)) == 0).groupBy("owner").count().filter(F.col("count") * LARGE_SHARE > LARGE_OWNER)
        large = F.broadcast(checkpoint(counted.select("owner"), "large"))  # eight bytes for each LARGE_OWNER super-windows at most
        narrow = scanned.select("owner", "content", "sides", F.col("copies").alias("n"))
        if large.isEmpty():
            near = _near(narrow)
        else:
            near = _near(narrow.join(large, "owner", "left_anti")).unionByName(_near_of_large(narrow.join(large, "owner", "left_semi")))
        groups = checkpoint(near, "owners")
        located = checkpoint(scanned.drop("sides").join(groups, ["owner", "content"]).filter("near or copies = 1"), "located")
        release(spark)

        def wanted(hot: bool) -> DataFrame:
            """h1, h2, content and wanted super-windows, each from one text."""
            place = F.struct("h1", "h2", "start", "windows", "size", "own")
            one = located.filter(F.col("near") & (F.col("hot") == hot)).groupBy("owner", "content").agg(F.min(place).alias("at"), F.max("n").alias("n"))
            by_text = one.select("at.h1", "at.h2", F.struct("owner", "n", "at.start", "at.windows", "at.size", "at.own").alias("w")).groupBy("h1", "h2").agg(F.collect_list("w").alias("wanted"))
            return texts.join(by_text, ["h1", "h2"]).select("h1", "h2", texts["content"], "wanted")

        dealt = wanted(hot=False).mapInArrow(_cut_pieces, _PIECES).repartition("owner").sortWithinPartitions("owner")
        marks = checkpoint(dealt.mapInArrow(_index(length, words, short), _MARKS), "marks")
        release(spark)

        if not groups.filter("near and hot").isEmpty():
            every = checkpoint(wanted(hot=True).mapInArrow(_hot_windows(length, words, short), _HOT), "hot")
            often = every.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key")
            marks = marks.unionByName(every.filter("n = 1").join(often, "key").select(marks.columns))

        low = F.col("start")
        whole = located.filter("n > 1 and copies = 1").select("h1", "h2", F.lit(WHOLE).alias("kind"), low.alias("low"), (low + F.col("size")).alias("high"))
        spans = whole.unionByName(marks).groupBy("h1", "h2").agg(F.collect_set(F.struct("kind", "low", "high")).alias("spans"))
        spans, kept = written(spans, "spans")
    for path in made:
        if path != kept:
            drop_written(spark, path)
    return spans, kept


def covered(data: np.ndarray, ends: np.ndarray, spans: tuple[np.ndarray, ...], length: int, words: int, short: int) -> tuple[tuple, tuple]:
    """What repeated windows cover of texts, and what repeated passages do: text, low and high of each stretch.

    ``data`` are texts that end at ``ends``; ``spans`` are text, kind, low and high, the latter in ``data``.
    """
    of, kind, low, high = spans
    gone = (kind != PASSAGE) & (high - low >= length)
    windows = unions(of[gone], low[gone], high[gone])
    whole = kind == WHOLE
    begins = stops = string = np.zeros(0, np.int64)
    if whole.any():
        begins, string, need = word_passages(data, np.append(0, ends[:-1]), words, short, length)
        stops = begins + need
        # How far the repeated stretch goes that a word begins in: the furthest of those that began before.
        order = np.argsort(low[whole])
        from_, reach = low[whole][order], np.maximum.accumulate(high[whole][order])
        at = np.searchsorted(from_, begins, "right") - 1
        hit = (at >= 0) & (stops <= reach[at])
        begins, stops, string = begins[hit], stops[hit], string[hit]
    own = kind == PASSAGE
    return windows, unions(np.concatenate([of[own], string]), np.concatenate([low[own], begins]), np.concatenate([high[own], stops]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, short: int = SHORT, with_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes and, if asked for, kept (the remaining bytes) of each row.

    Every byte that a window of ``length`` bytes covers goes if the window also
    starts anywhere else in the texts, judged on the input.  ``n_passages`` counts
    the stretches that repeated passages cover, and ``passage_bytes`` their bytes;
    a passage goes from a word's first byte to the first byte of the
    ``words``-th word from there, but over ``short`` bytes at least and
    ``length`` at most, and it is repeated if it is a passage anywhere else too.
    Words are separated by ASCII white space.  A null text is empty; texts
    shorter than a window stay.  Rows that repeat id and text are copies of each
    other, and so all their windows are repeated.  Other columns are not read;
    no rows give no rows.
    """
    spark, short, width = docs.sparkSession, min(short, length), 5 + with_kept
    texts, (name, path) = distinct_texts(docs, text_col)
    release(spark)
    spans, spans_at = repeated_spans(texts, length, words, short)
    columns = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long" + ", kept binary" * with_kept
    names = [x.split()[0] for x in columns.split(", ")]

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        lists = batch.column(4)
        fields = lists.flatten()
        of = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        kind, low, high = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        low, high = low + begins[of], high + begins[of]
        twice = np.flatnonzero((batch.column(2).to_numpy() > 1) & (sizes > 0))  # texts that have copies
        of, kind = np.concatenate([of, twice]), np.concatenate([kind, np.full(len(twice), WHOLE)])
        low, high = np.concatenate([low, begins[twice]]), np.concatenate([high, ends[twice]])
        gone, passages = covered(np.frombuffer(b"".join(texts), np.uint8), ends, (of, kind, low, high), length, words, short)
        cuts: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(gone[0].tolist(), (gone[1] - begins[gone[0]]).tolist(), (gone[2] - begins[gone[0]]).tolist(), strict=True):
            cuts.setdefault(i, []).append((a, b))
        left = []
        for i, text in enumerate(texts):
            at, parts = 0, []
            for a, b in cuts.get(i, ()):
                parts.append(text[at:a])
                at = b
            left.append(b"".join([*parts, text[at:]]))
        count = lambda x: pa.array(np.bincount(x[0], minlength=len(texts)).astype(np.int64))
        total = lambda x: pa.array(np.bincount(x[0], x[2] - x[1], len(texts)).astype(np.int64))
        hashes = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
        found = [pa.array(sizes), total(gone), count(gone), hashes, count(passages), total(passages), pa.array(left, pa.binary())]
        return pa.record_batch([batch.column(0), batch.column(1), *found[: width + 1]], names=["h1", "h2", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):  # as many texts as have about SCAN_BYTES, one at least
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * SCAN_BYTES)))
                yield judged(batch.slice(at, stop - at))
                at = stop

    of_texts = texts.join(spans, ["h1", "h2"], "left").select("h1", "h2", "copies", "content", "spans").mapInArrow(run, f"h1 long, h2 long, {columns}")
    found = checkpoint(of_texts, "found")
    spark.sql(f"drop table {name}")
    for at in (path, spans_at):
        drop_written(spark, at)
    release(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *digest_of(text_col))
    return rows.join(found, ["h1", "h2"]).select("doc_id", *names)
