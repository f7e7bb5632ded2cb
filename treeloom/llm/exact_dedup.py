"""Exact deduplication over a cuckoo-filter index of live digests.

Each input partition combines its own copies first, so a text that a third of
all rows share crosses the shuffle a few times, not once a row.  Digests are
then dealt by value and sorted; each task keeps a :class:`CuckooIndex` of bounded size
whose filter answers most lookups, whose hits are verified against the stored
keys of the bucket, and whose entries are deleted and inserted again when a
later row takes over a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_with_common, text_of

SLOTS = 4
MAX_KICKS = 64
#: Digests that an index holds before it goes on with an empty one; a task sees digests in order, so none comes again.
INDEX_ENTRIES = 500_000


class CuckooIndex:
    """A cuckoo filter whose slots also point at the stored key, so that a hit can be verified.

    ``put`` inserts a digest with its value, ``get`` finds it, ``remove``
    deletes it.  A run of ``MAX_KICKS`` evictions is an overflow: the table
    doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 256) -> None:
        self.mask = max(2, 1 << (buckets - 1).bit_length()) - 1
        self.prints: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.refs: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.keys: list[bytes | None] = []
        self.values: list[tuple | None] = []
        self.free: list[int] = []
        self.resizes = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "big") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[2:10], "big") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _find(self, key: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a verified hit."""
        mark, home = self._print(key), self._home(key)
        for bucket in (home, self._other(home, mark)):
            for slot, seen in enumerate(self.prints[bucket]):
                if seen == mark and self.keys[self.refs[bucket][slot]] == key:
                    return bucket, slot
        return None

    def get(self, key: bytes) -> tuple | None:
        at = self._find(key)
        return None if at is None else self.values[self.refs[at[0]][at[1]]]

    def remove(self, key: bytes) -> bool:
        at = self._find(key)
        if at is None:
            return False
        bucket, slot = at
        ref = self.refs[bucket][slot]
        for held in (self.prints, self.refs):
            held[bucket][slot] = held[bucket][-1]
            held[bucket].pop()
        self.keys[ref] = self.values[ref] = None
        self.free.append(ref)
        return True

    def put(self, key: bytes, value: tuple) -> None:
        """Insert a digest that is not in the index."""
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.values[ref] = key, value
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        while not self._place(self._print(key), ref, self._home(key)):
            self._grow()
            return  # _grow placed every stored key, this one too

    def _place(self, mark: int, ref: int, bucket: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.refs[b].append(ref)
                return True
        b = bucket
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            self.prints[b][slot], mark = mark, self.prints[b][slot]
            self.refs[b][slot], ref = ref, self.refs[b][slot]
            b = self._other(b, mark)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.refs[b].append(ref)
                return True
        return False

    def _grow(self) -> None:
        full = False
        while not full:
            self.resizes += 1
            self.mask = self.mask * 2 + 1
            self.prints = [[] for _ in range(self.mask + 1)]
            self.refs = [[] for _ in range(self.mask + 1)]
            full = all(self._place(self._print(k), ref, self._home(k)) for ref, k in enumerate(self.keys) if k is not None)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for key, value in zip(self.keys, self.values, strict=True):
            if key is not None:
                yield key, value


_PART = "digest binary, keep_id long, group_size long"


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: the largest id, the number of rows."""
    for batch in batches:
        got = pa.table({"digest": batch.column(0), "keep_id": batch.column(1)}).group_by("digest").aggregate([("keep_id", "max"), ([], "count_all")])
        got = got.select(["digest", "keep_id_max", "count_all"]).rename_columns(["digest", "keep_id", "group_size"])
        yield from got.combine_chunks().to_batches()


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    """The live entries of an index."""
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.record_batch([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "keep_id", "group_size"])


def _larger(a: int | None, b: int | None) -> int | None:
    return max((x for x in (a, b) if x is not None), default=None)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed a task's digests, which come in order, through cuckoo indexes of bounded size and return the live entries.

    Rows may have a step: 1 removes a digest, and what comes after it is inserted anew.
    """
    index, last = CuckooIndex(), None
    for batch in batches:
        for key, keep, size, *step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and len(index) >= INDEX_ENTRIES:
                yield from _entries(index)
                index = CuckooIndex()
            last = key
            held = index.get(key)
            if held is not None:
                index.remove(key)
            if step == [1]:
                continue
            if held is not None:
                keep, size = _larger(keep, held[0]), size + held[1]
            index.put(key, (keep, size))
    yield from _entries(index)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The live digests of ``docs``: digest, keep_id (largest id of the group), group_size."""
    keyed = docs.select(F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), F.col(id_col).cast("long").alias("keep_id"))
    return keyed.mapInArrow(_combine, _PART).repartition("digest").sortWithinPartitions("digest").mapInArrow(_index, _PART)


def update_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index after documents came and the digests of ``removed`` went.

    Removal comes first: a text in both is live again with the added rows only.
    """
    parts = [index.select("digest", "keep_id", "group_size", F.lit(0).alias("step"))]
    if removed is not None:
        gone = removed.select(F.unhex(F.sha2(text_of(text_col), 256)).alias("digest")).distinct()
        parts.append(gone.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("step")))
    if added is not None:
        parts.append(build_index(added, id_col, text_col).select("*", F.lit(2).alias("step")))
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)

    return changes.repartition("digest").sortWithinPartitions("digest", "step").mapInArrow(_index, _PART)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on each row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are one group.  A null id is
    smaller than any other, so a group keeps it only where it has no other id.
    Rows that repeat both id and text are one document listed more than once
    and carry the same verdict.  Columns other than id and text are not read.
    No rows give no rows.
    """
    groups = checkpoint(build_index(docs, id_col, text_col).withColumnRenamed("digest", "__digest"), "digests")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("__digest"))
    return join_with_common(rows, groups, "__digest", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each group of equal texts.

    It is of the largest id; of rows that repeat id and text any one stays.
    Those are combined before they are shuffled.
    """

    def key(digest: Column, doc_id: Column) -> Column:
        return F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary"))

    groups = build_index(docs, id_col, text_col).select(key(F.col("digest"), F.col("keep_id")).alias("__x_key"))
    keyed = docs.withColumn("__x_key", key(F.unhex(F.sha2(text_of(text_col), 256)), F.col(id_col).cast("long")))
    return keyed.dropDuplicates(["__x_key"]).join(groups, "__x_key", "left_semi").select(docs.columns)
