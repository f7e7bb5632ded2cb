"""Quality from weak labels.

Heuristic labellers vote good, bad or nothing on each text.  Expectation
maximisation over the counts of all vote patterns of the corpus estimates how
accurate each labeller is; the posterior of a text's pattern is its training
label for a hashed linear scorer, which scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .learning import fit_logistic, ngram_counts, scaled, stacked, text_sample

BAD, GOOD, NONE = 0, 1, 2
LABELLERS = 12
#: Texts with fewer words get no vote from labellers of proportions.
MIN_WORDS = 5
ORDERS, BITS = (1, 2, 3), 11
#: Rows that the scorer is fitted on.
FIT_ROWS = 4000
KEEP_SCORE = 0.5
#: What is believed of a labeller beforehand: so often its votes are right, with the weight of such a share of its votes.
BELIEF, BELIEF_SHARE = 0.98, 0.01
SYMBOLS = re.compile(r"[%*&$#@^~|<>{}\[\]\\_=+!]")
#: Share of a proportion's range, in parts of a hundred, at which its hashed token changes.
CUTS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def measures(text: str) -> dict[str, float]:
    """Proportions of a whole text that the labellers judge; words is a count."""
    words = text.split()
    n = len(words)
    if not n:
        return dict.fromkeys(("words", "symbols", "upper", "repeated", "stutter", "lines", "bars", "length", "digits", "echo", "squeeze"), 0.0)
    chars = len(text)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text))) or 1
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": float(n),
        "symbols": len(SYMBOLS.findall(text)) / chars,
        "upper": upper / letters,
        "repeated": 1 - len(counts) / n if n < 200 else max(0.0, counts.most_common(1)[0][1] / n),
        "stutter": sum(map(str.__eq__, words, words[1:])) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "bars": counts.get("|", 0) / n,
        "length": (chars - n) / n,
        "digits": sum(map(len, re.findall(r"\d+", text))) / chars,
        "echo": sum(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False)) / n,
        "squeeze": len(zlib.compress(text.encode("utf-8", "replace"), 1)) / chars,
    }


def _vote(value: float, good_below: float, bad_above: float) -> int:
    return GOOD if value <= good_below else BAD if value >= bad_above else NONE


def votes(m: dict[str, float]) -> list[int]:
    """Each labeller's vote; overlapping labellers look at the same fault from different sides."""
    if m["words"] < MIN_WORDS:
        return [BAD if m["words"] == 0 else NONE] + [NONE] * (LABELLERS - 1)
    return [
        GOOD if m["words"] >= 20 else NONE,
        _vote(m["symbols"], 0.01, 0.08),
        _vote(m["symbols"] + m["bars"], 0.02, 0.15),
        _vote(m["upper"], 0.15, 0.4),
        _vote(m["repeated"], 0.4, 0.75),
        _vote(m["stutter"], 0.03, 0.2),
        _vote(m["lines"], 0.2, 0.6),
        _vote(m["bars"], 0.01, 0.1),
        BAD if m["length"] > 15 or m["length"] < 2 else GOOD if 3 <= m["length"] <= 8 else NONE,
        _vote(m["digits"], 0.05, 0.25),
        _vote(m["echo"], 0.01, 0.1),
        NONE if m["words"] < 50 else GOOD if 0.25 <= m["squeeze"] <= 0.7 else BAD if m["squeeze"] < 0.2 else NONE,
    ]


@dataclass
class LabelModel:
    prior: float  # of good
    log_odds: np.ndarray  # labellers x votes
    accuracy: np.ndarray  # of each labeller's votes


def fit_labels(patterns: list[tuple[str, int]], rounds: int = 200) -> LabelModel:
    """Expectation maximisation over (vote pattern, number of texts).

    A labeller has a distribution of good and bad votes for either class of
    text; a vote for nothing says nothing.  The estimates are maxima of the
    posterior: a belief that labellers are right counts as a small share of their
    own votes, which says which class is which.  At first each vote for bad is
    taken to be right nine times out of ten.
    """
    if not patterns:
        return LabelModel(0.5, np.zeros((LABELLERS, 3)), np.full(LABELLERS, 0.5))
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    onehot = (v[:, :, None] == np.arange(3)).astype(float)
    given = np.ones((2, v.shape[1], 3))
    good = np.clip(0.1 ** (v == BAD).sum(axis=1), 1e-6, 0.98)
    prior, log_odds = 0.5, np.zeros((v.shape[1], 3))
    voted = np.einsum("p,pjv->j", n, onehot[:, :, :NONE])[:, None]
    belief = np.array([[BELIEF, 1 - BELIEF], [1 - BELIEF, BELIEF]])  # of classes bad and good, votes bad and good
    for _ in range(rounds):
        prior = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
        for y, q in ((0, 1 - good), (1, good)):
            mass = np.einsum("p,pjv->jv", q * n, onehot)[:, :NONE] + BELIEF_SHARE * voted * (prior if y else 1 - prior) * belief[y] + 0.1
            given[y, :, :NONE] = mass / mass.sum(axis=1, keepdims=True)
        log_odds = np.log(given[1]) - np.log(given[0])
        odds = np.log(prior / (1 - prior)) + (onehot * log_odds).sum(axis=(1, 2))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = prior * given[1][:, GOOD] + (1 - prior) * given[0][:, BAD]
    voted = right + prior * given[1][:, BAD] + (1 - prior) * given[0][:, GOOD]
    return LabelModel(prior, log_odds, right / np.maximum(voted, 1e-9))


def posterior(model: LabelModel, vote: list[int]) -> float:
    odds = np.log(model.prior / (1 - model.prior)) + sum(model.log_odds[j, v] for j, v in enumerate(vote))
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def features(text: str, m: dict[str, float]) -> np.ndarray:
    """Hashed byte n-grams, and hashed tokens for the range that each measure falls into."""
    grams = scaled(ngram_counts(text.encode("utf-8", "replace"), ORDERS, BITS))
    tokens = np.zeros(1 << 8, np.float32)
    for i, (name, value) in enumerate(m.items()):
        level = int(min(15, value).bit_length()) if isinstance(value, int) else int(np.log2(value + 1)) if name in ("words", "length") else sum(value >= c for c in CUTS)
        tokens[(i * 16 + level) & 255] = 0.5
    return np.concatenate([grams, tokens])


def train(model: LabelModel, texts: list[str]) -> np.ndarray:
    """Weights of the scorer, fitted to the posterior labels of ``texts``."""
    if not texts:
        return np.zeros(len(ORDERS) * (1 << BITS) + (1 << 8) + 1, np.float32)
    found = [measures(t) for t in texts]
    x = stacked((features(t, m) for t, m in zip(texts, found, strict=True)), len(texts))
    y = np.array([posterior(model, votes(m)) for m in found], np.float32)
    return fit_logistic(x, y, rounds=300)[:, 0]


def vote_patterns(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int]]:
    """How many texts got each pattern of votes, over all rows; at most one pattern for each combination of votes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter("".join(map(str, votes(measures(t)))) for t in batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return sorted((r[0], r[1]) for r in rows)


def score(docs: DataFrame, model: LabelModel, weights: np.ndarray, keep_score: float = KEEP_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, posterior, keep of each whole text.

    A null text counts as empty.  Without any training row every score is one
    half.  Repeated rows are scored again; other columns are not read; no rows
    give no rows.
    """
    weights = weights.astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, labels = [], []
            for text in batch.column(1).to_pylist():
                m = measures(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(float(features(text, m) @ weights[:-1] + weights[-1]), -30, 30)))))
                labels.append(posterior(model, votes(m)))
            p = pa.array(scores, pa.float64())
            yield pa.record_batch([batch.column(0), p, pa.array(labels, pa.float64()), pa.array([s >= keep_score for s in scores], pa.bool_())], names=["doc_id", "score", "posterior", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, posterior double, keep boolean")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, np.ndarray]:
    """Label model over all texts, and the scorer fitted on a bounded sample of them."""
    model = fit_labels(vote_patterns(docs, text_col))
    return model, train(model, text_sample(docs, fit_rows, id_col, text_col))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``docs`` and score its rows; see :func:`score`."""
    return score(docs, *fit(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def accepted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_score: float = KEEP_SCORE) -> DataFrame:
    """``docs`` with its own columns, without the rows that the scorer rejects."""
    model, weights = fit(docs, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                m = measures(text or "")
                keep.append(1 / (1 + np.exp(-np.clip(float(features(text or "", m) @ weights[:-1] + weights[-1]), -30, 30))) >= keep_score)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
