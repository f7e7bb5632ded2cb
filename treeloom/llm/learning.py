"""What the learned operators share: bounded labelled samples, hashed n-grams, a linear trainer."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Rows of each class, and bytes of text in all, that a model is fitted on.
ROWS_PER_CLASS, SAMPLE_BYTES = 2000, 24 << 20
#: Rows of all classes together.
ROWS_IN_ALL = 20_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no model may learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, str]]:
    """(text, label) of a bounded sample of rows.

    ``labels`` has doc_id and label.  About ``rows_per_class`` rows of each
    class, ``ROWS_IN_ALL`` rows together, are taken by a hash of their id, then in
    hash order while their texts fit ``sample_bytes``; a text that does not fit,
    or that has over a sixteenth of these bytes, is passed over.  Texts are
    whole, null labels and texts are passed over.  A row that is repeated counts
    once; of an id with several texts the one with the least digest is taken.
    """
    order = F.xxhash64("__id")
    labels = labels.filter("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("label").cast("string").alias("__label"))
    counts = labels.groupBy("__label").agg(F.approx_count_distinct("__id", 0.02).alias("n")).collect()  # a row for each class of the model
    if not counts:
        return []
    rows_per_class = max(1, min(rows_per_class, ROWS_IN_ALL // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, rows_per_class / r[1])))])
    taken = labels.filter((order / F.lit(float(1 << 63)) + 1) / 2 < share[F.col("__label")]).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).filter("__text is not null")
    # ``taken`` has about ROWS_IN_ALL rows at most, by the shares.
    found = texts.join(F.broadcast(taken), "__id").select("__id", "__label", F.struct(F.sha2("__text", 256).alias("digest"), F.octet_length("__text").alias("size")).alias("t"))
    sizes = found.groupBy("__id", "__label").agg(F.min("t").alias("t")).select("__id", "__label", "t.digest", "t.size", order.alias("order")).collect()
    total, chosen = 0, []
    for r in sorted(sizes, key=lambda r: (r["order"], r["__id"], r["__label"])):
        if r["size"] <= sample_bytes // 16 and total + r["size"] <= sample_bytes:
            total += r["size"]
            chosen.append((r["__id"], r["digest"], r["__label"]))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted({(i, d) for i, d, _ in chosen}), "__id long, __digest string")
    got = texts.join(F.broadcast(wanted), "__id").filter(F.sha2("__text", 256) == F.col("__digest"))
    held = dict(got.groupBy("__id").agg(F.first("__text")).collect())  # all of one digest, so any is the first
    return [(held[i], label) for i, _, label in chosen]


def text_sample(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Texts of about ``rows`` rows, taken by a hash of their id under the bounds of :func:`labelled_sample`."""
    labels = docs.select(F.col(id_col).alias("doc_id"), F.lit("x").alias("label"))
    return [t for t, _ in labelled_sample(docs, labels, rows, id_col=id_col, text_col=text_col)]


def ngram_counts(data: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the hashed byte n-grams of ``data``, a slot for each of 2**bits values of each order."""
    out = np.zeros((len(orders), 1 << bits), np.float32)
    for start in range(0, len(data), 1 << 20):
        part = np.frombuffer(data[start : start + (1 << 20) + max(orders) - 1], np.uint8).astype(np.uint32)
        for row, order in enumerate(orders):
            n = min(1 << 20, len(part) - order + 1)
            if n <= 0:
                continue
            h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(order):
                h = (h ^ part[i : i + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            out[row] += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, of length one for each order."""
    x = np.sqrt(counts)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9
    return x.ravel()


def stacked(rows: Iterable[np.ndarray], n: int) -> np.ndarray:
    """A matrix of ``n`` rows, filled one by one so that they are held once."""
    out = np.zeros((0, 0), np.float32)
    for i, row in enumerate(rows):
        if not i:
            out = np.zeros((n, len(row)), np.float32)
        out[i] = row
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 200, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights and a last row of biases for targets ``y`` in 0 to 1, a column each, by accelerated gradient steps."""
    y = y.reshape(len(x), -1).astype(np.float32)
    weight = (np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32))[:, None]
    weight = weight / weight.sum()
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    ahead = w.copy()
    for step in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        e = (p - y) * weight
        grad = np.vstack([x.T @ e + decay * ahead[:-1], e.sum(axis=0, keepdims=True)])
        new = ahead - rate * grad
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def texts_with_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and text (null as empty)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
