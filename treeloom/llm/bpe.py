"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself.  A segment tree over its
byte positions stores, at every node, the leftmost position with the smallest
pair rank below it; a merge changes the pair of at most three live positions,
each a logarithmic point update.  Matches recur, so a task remembers the ids
of short ones in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Larger than any rank: the position starts no pair of the vocabulary.
NO_PAIR = 1 << 60
#: Matches of at most so many bytes are remembered, so many of them at a time.
MEMO_BYTES, MEMO_ENTRIES = 64, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank on each line."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class _Memo(dict):
    """Of a match: its ids as text, their number, the bytes they decode to, the ids as bytes; only short ones stay."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, match: str) -> tuple[str, int, bytes, bytes]:
        ids = self.bpe.merge(match.encode("utf-8", "surrogatepass"))
        found = ",".join(map(str, ids)), len(ids), self.bpe.decode(ids), array("i", ids).tobytes()
        if len(match) <= MEMO_BYTES:
            self[match] = found
        return found


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks = len(piece), self.ranks
        get = ranks.get
        end = list(range(1, n + 1))  # of the live part that starts here
        before = list(range(-1, n - 1))  # start of the live part on the left
        # A node of the tree holds rank * leaves + position, so the smallest is the leftmost of the smallest rank.
        leaves = 1 << (n - 1).bit_length()
        bits = leaves.bit_length() - 1
        tree = [NO_PAIR] * (2 * leaves)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[leaves + i] = rank << bits | i
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        while tree[1] != NO_PAIR:
            at = tree[1] & (leaves - 1)
            gone = end[at]
            end[at] = after = end[gone]
            rank = None
            if after < n:
                before[after] = at
                rank = get(piece[at : end[after]])
            changed = [(gone, NO_PAIR), (at, NO_PAIR if rank is None else rank << bits | at)]
            left = before[at]
            if left >= 0:
                rank = get(piece[left:after])
                changed.append((left, NO_PAIR if rank is None else rank << bits | left))
            for node, best in changed:
                node += leaves
                if tree[node] == best:
                    continue
                tree[node] = best
                while node > 1:
                    other = tree[node ^ 1]
                    if other < best:
                        best = other
                    node >>= 1
                    if tree[node] == best:
                        break
                    tree[node] = best
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at : end[at]]])
            at = end[at]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for match in self.split.findall(text):
            ids += self.merge(match.encode("utf-8", "surrogatepass"))
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str, bytes]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the bytes decoded from them, the ids as 4 bytes each."""
        matches = self.split.findall(text)
        if not matches:
            return 0, _NOTHING, _NOTHING, b""
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        ids, counts, content, packed = zip(*map(self.memo.__getitem__, matches), strict=True)
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(content)).hexdigest(), b"".join(packed)


_NOTHING = hashlib.sha256(b"").hexdigest()


_HELD: dict[tuple[str, str], ByteBpe] = {}


def codec(rank_path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file, loaded once in each worker."""
    key = (rank_path, pattern)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = ByteBpe(load_ranks(rank_path), pattern)
    return _HELD[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; a null or empty text has no ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row of :func:`encode`; null ids decode to no bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, content binary")


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both.

    doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas),
    decoded_sha256 (the decoded bytes) and, if asked for, ids.  A null text is empty: no tokens, and
    both digests are those of no bytes.  A repeated row is encoded again.
    Other columns are not read.  No rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_path, pattern)
        for batch in batches:
            found = [bpe.digest(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *(f[0] for f in found)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(f[3] for f in found), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
