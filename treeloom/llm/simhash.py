"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits.  Two fingerprints
within distance T agree in some partition i up to its threshold T_i whenever
the T_i + 1 add up to T + 1; a dynamic programme picks the thresholds with the
fewest candidates and probes, estimated from the histograms of the partitions.
The more fingerprints there are, the fewer and wider partitions are worth their
probes, so their number follows from the same estimate.  Distinct fingerprints
are probed by partition value, candidates are verified on all bits, and each
bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, collected, drop_written, join_with_common, text_of, written
from .components import components

WORDS, SEED, DISTANCE = 4, 42, 4
#: Numbers of partitions that are weighed against each other; fewer than 4 where there are so many fingerprints.
PARTITIONS, MANY = (4, 3, 2), 1 << 22
#: Bits of a histogram, which is counted exactly; wider partitions are estimated from parts of such a width.
HISTOGRAM_BITS = 16
#: Candidates that cost as much as one probe.
PROBE_COST = 250.0
#: Members of a bucket that one task compares; larger buckets are dealt out block by block.
BLOCK = 20_000
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str) -> int:
    """64-bit SimHash of the 4-word shingles of a text; 0 for a text without words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > WORDS:
        starts, ends = starts[: n - WORDS + 1], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, m = xxhash.xxh64_intdigest, len(starts)
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 16384):
        part = hashes[at : at + 16384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _joint_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together."""
    total = np.zeros((64, 64))
    for batch in batches:
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for at in range(0, len(x), 1 << 16):
            total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
    yield pa.record_batch([pa.array(np.arange(64 * 64)), pa.array(total.ravel())], names=["cell", "n"])


def group_bits(joint: np.ndarray, total: int, partitions: int) -> list[list[int]]:
    """Partitions of equal size, each grown from a bit by those that are most correlated with it so far."""
    p = joint / max(1, total)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    near = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, out = set(range(64)), []
    for i in range(partitions):
        size = len(free) // (partitions - i)
        group = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def project(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a partition, packed."""
    wide = fp.view(np.uint64)
    out = np.zeros(len(fp), np.int64)
    for i, bit in enumerate(group):
        out |= ((wide >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def _histograms(groups: list[list[int]]):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(g), np.int64) for g in groups]
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for held, g in zip(counts, groups, strict=True):
                held += np.bincount(project(fp, g), minlength=len(held))
        for i, held in enumerate(counts):
            at = np.flatnonzero(held)
            yield pa.record_batch([pa.array(np.full(len(at), i)), pa.array(at), pa.array(held[at])], names=["part", "value", "n"])

    return run


def pieces_of(group: list[int]) -> list[list[int]]:
    """A partition's bits in parts that have a histogram."""
    parts = -(-len(group) // HISTOGRAM_BITS)
    return [group[i::parts] for i in range(parts)]


def costs_of(histograms: list[np.ndarray], width: int, total: int, distance: int) -> np.ndarray:
    """Candidates and probes of a partition for each threshold up to ``distance``.

    Of a partition in several parts, distances are taken to be independent from one part to another.
    """
    pairs = np.ones(1)
    for held in histograms:
        pairs = np.convolve(pairs, pairs_by_distance(held) / max(1, total) ** 2)
    pairs = np.pad(pairs, (0, distance + 1))[: distance + 1]
    probes = np.array([comb(width, t) for t in range(distance + 1)], float)
    return np.cumsum(pairs) * total**2 + np.cumsum(probes) * total * PROBE_COST


def pairs_by_distance(histogram: np.ndarray) -> np.ndarray:
    """How many ordered pairs of members differ in 0, 1, 2, ... bits, by the Walsh-Hadamard transform."""
    x = histogram.astype(np.float64)
    step = 1
    while step < len(x):
        x = x.reshape(-1, 2, step)
        x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
        step *= 2
    x = x * x
    step = 1
    while step < len(x):
        x = x.reshape(-1, 2, step)
        x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
        step *= 2
    x /= len(x)
    return np.bincount(np.bitwise_count(np.arange(len(x))), weights=np.maximum(x, 0))


def allocate(costs: list[np.ndarray], distance: int) -> list[int]:
    """Thresholds (-1: unused) whose T_i + 1 add up to ``distance`` + 1 at the least sum of costs.

    ``costs[i][t]`` is the number of candidates of partition i at threshold t.
    """
    need = distance + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * need
    for cost in costs:
        new: list[tuple[float, list[int]]] = [(np.inf, [])] * (need + 1)
        for had, (spent, chosen) in enumerate(best):
            for units in range(need - had + 1):
                more = 0.0 if units == 0 else float(cost[units - 1]) if units <= len(cost) else np.inf
                if spent + more < new[had + units][0]:
                    new[had + units] = spent + more, [*chosen, units - 1]
        best = new
    return best[need][1]


class Blocks:
    """Into how many blocks the members and probes of each bucket are dealt out: one, unless they are more than a block."""

    def __init__(self, values: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(values)
        self.values, self.parts = values[order], parts[order]

    def __getitem__(self, value: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.ones(len(value), np.int64)
        at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        return np.where(self.values[at] == value, self.parts[at], 1)


def blocks_of(values: np.ndarray, counts: np.ndarray, around: np.ndarray, block: int) -> Blocks:
    """The blocks of buckets, of the values that have more than their share of a block of members.

    ``around`` are the masks of the probes: a bucket is probed by the members of
    the buckets around it.  Values left out add less than a block in all.
    """
    buckets = np.concatenate([values, *(values ^ mask for mask in around)]) if len(values) else values
    members = np.tile(counts, len(around) + 1) if len(values) else counts
    own, at = np.unique(buckets, return_inverse=True)
    held = np.bincount(at, members, len(own)) if len(own) else np.zeros(0)
    parts = np.ceil(held / block).astype(np.int64)
    return Blocks(own[parts > 1], parts[parts > 1])


def masks(width: int, threshold: int) -> np.ndarray:
    """Values with 1 to ``threshold`` of ``width`` bits set."""
    return np.array([sum(1 << b for b in c) for t in range(1, threshold + 1) for c in combinations(range(width), t)], np.int64)


def _probes(groups: list[list[int]], thresholds: list[int], blocks: list[Blocks]):  # noqa: ANN202
    """Rows (bucket, task, role, fp): role 0 is in the index of a bucket, role 1 probes it; a task is a pair of its blocks."""

    def deal(i: int, value: np.ndarray, fp: np.ndarray, role: int) -> Iterator[pa.RecordBatch]:
        parts = blocks[i][value]
        own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
        for k in range(int(parts.max(initial=0))):
            now = parts > k
            yield row(i, value[now], (np.int64(k) << 24) | own[now], 1, fp[now])
            if role == 0:
                yield row(i, value[now], (own[now] << 24) | k, 0, fp[now])

    def row(i: int, value: np.ndarray, pair: np.ndarray, role: int, fp: np.ndarray) -> pa.RecordBatch:
        # Role in the lowest bit, so that a bucket's index comes before its probes.
        return pa.record_batch([pa.array((np.int64(i) << 32) | value), pa.array((pair << 1) | role), pa.array(fp)], names=["bucket", "task", "fp"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for i, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                value = project(fp, group)
                single = blocks[i][value] == 1  # all of a small bucket are together: its members are in its index only
                yield row(i, value[single], np.zeros(single.sum(), np.int64), 0, fp[single])
                yield from deal(i, value[~single], fp[~single], 0)
                for mask in masks(len(group), t):
                    yield from deal(i, value ^ mask, fp, 1)

    return run


def forest(index: np.ndarray, probes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever lies within ``distance`` of an index member, each member reached once."""
    members = np.concatenate([index, probes]).view(np.uint64)
    left = np.arange(len(members))
    roots = 0
    while roots < len(index):
        if left[0] >= len(index):
            return
        queue, left = [left[0]], left[1:]
        roots += 1
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(members[left] ^ members[at]) <= distance
            if near.any():
                found = left[near]
                yield np.full(len(found), members[at]), members[found]
                roots += int((found < len(index)).sum())
                queue.extend(found.tolist())
                left = left[~near]
        if not len(left):
            return


def _verify(distance: int):  # noqa: ANN202
    """Links of the buckets in rows sorted by bucket and task."""

    def links(bucket: np.ndarray, task: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(task >> 1) != 0)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(task)]])
        some = np.concatenate([[0], np.cumsum(task & 1 == 0)])
        firsts = some[stops] - some[starts]
        use = (firsts > 0) & (stops - starts > 1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, k in zip(starts[use].tolist(), stops[use].tolist(), firsts[use].tolist(), strict=True):
            out += forest(fp[a : a + k], fp[a + k : b], distance)
        if out:
            yield pa.record_batch([pa.array(np.concatenate([x for x, _ in out]).view(np.int64)), pa.array(np.concatenate([y for _, y in out]).view(np.int64))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] >> 1 == now[1][-1] >> 1)  # rows of the last task, which may go on
            cut = int(np.argmax(same))
            if cut or (held and (held[-1][0][-1], held[-1][1][-1] >> 1) != (now[0][0], now[1][0] >> 1)):
                whole = [np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in now), strict=True)]
                yield from links(*whole)
                held = []
            held.append(tuple(c[cut:] for c in now))
        if held:
            yield from links(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def plan(fps: DataFrame, distance: int, numbers: tuple[int, ...]) -> tuple[list[list[int]], list[int], list[list[np.ndarray]]]:
    """Partitions, thresholds and histograms for fingerprints, of the cheapest of some numbers of partitions."""
    total = fps.count()
    cells = fps.mapInArrow(_joint_counts, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect()  # 64 x 64
    joint = np.zeros(64 * 64)
    for cell, n in cells:
        joint[cell] = n
    if total < MANY and max(numbers) >= 4:
        numbers = tuple(n for n in numbers if n >= 4)
    choices = [group_bits(joint.reshape(64, 64), total, n) for n in numbers]
    parts = [part for groups in choices for group in groups for part in pieces_of(group)]
    counts = [np.zeros(1 << len(p), np.int64) for p in parts]
    # At most 2**HISTOGRAM_BITS values of each part.
    for part, value, n in fps.mapInArrow(_histograms(parts), "part long, value long, n long").groupBy("part", "value").agg(F.sum("n")).collect():
        counts[part][value] = n
    left, best = iter(counts), (np.inf, [], [], [])
    for groups in choices:
        held = [[next(left) for _ in pieces_of(group)] for group in groups]
        costs = [costs_of(h, len(group), total, distance) for h, group in zip(held, groups, strict=True)]
        thresholds = allocate(costs, distance)
        cost = sum(c[t] for c, t in zip(costs, thresholds, strict=True) if t >= 0)
        if cost < best[0]:
            best = (cost, groups, thresholds, held)
    return best[1:]


def link(distinct: DataFrame, distance: int = DISTANCE, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp) that connect all within ``distance``."""
    fps = distinct.select("fp")
    groups, thresholds, histograms = plan(fps, distance, (partitions,) if partitions else PARTITIONS)
    if not groups:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    around = [masks(len(g), max(0, t)) for g, t in zip(groups, thresholds, strict=True)]
    blocks = []
    for group, t, mask, held in zip(groups, thresholds, around, histograms, strict=True):
        least = block // (len(mask) + 1)
        if t < 0 or len(held) == 1:
            values = np.flatnonzero(held[0] > least) if t >= 0 else np.zeros(0, np.int64)
            blocks.append(blocks_of(values, held[0][values], mask, block))
            continue
        # Not more values than fingerprints over a block's share of them.
        value = sum((F.shiftright("fp", bit).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, bit in enumerate(group)), F.lit(0).cast("long"))
        heavy = fps.groupBy(value.alias("v")).count().filter(F.col("count") > least).collect()
        blocks.append(blocks_of(np.array([r[0] for r in heavy], np.int64), np.array([r[1] for r in heavy], np.int64), mask, block))
    rows = fps.mapInArrow(_probes(groups, thresholds, blocks), "bucket long, task long, fp long")
    return rows.repartition("bucket", F.shiftright("task", 1)).sortWithinPartitions("bucket", "task").mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    ``component_id`` is the smallest doc_id that links of ``distance`` or fewer
    bits reach, the row's own included; null ids are passed over, so that a
    component of null ids alone has a null one.  A null text, like one without
    words, has fingerprint zero.  Repeated rows share their component.  Other
    columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    fps = checkpoint(fingerprints(docs, id_col, text_col), "fingerprints")
    with collected() as made:
        distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
        nodes = components(link(distinct, distance, partitions))
        linked = nodes.join(distinct, nodes["node"] == distinct["fp"]).select("node", "root", "least")
        least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        found = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
        named, named_at = written(distinct.join(found, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    for path in made:
        if path != named_at:
            drop_written(spark, path)
    return join_with_common(fps, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, the document with the smallest id of each component."""
    first = near_duplicates(docs, id_col=id_col, text_col=text_col).select(F.col("component_id").alias("__x_first")).distinct()
    return docs.join(first, docs[id_col].cast("long").eqNullSafe(first["__x_first"]), "left_semi")
