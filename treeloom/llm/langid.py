"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary n-gram classifier predicts
each bit.  A text takes the language whose codeword loses least, each bit
weighted by how well it was learned for that language; a close second marks
the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fit_logistic, held_out, labelled_sample, ngram_counts, scaled, stacked, texts_with_id

ORDERS, BITS = (1, 2, 3), 12
ROWS_PER_LANGUAGE = 600
#: Texts whose two best languages are nearer than this in score are ambiguous.
MARGIN = 0.2
LETTER = regex.compile(r"\p{L}")
#: All ASCII that is no letter, as spaces.
SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    trust: np.ndarray  # languages x bits, rows add up to 1
    weights: np.ndarray  # features + 1, bits


def features(text: str) -> np.ndarray:
    return scaled(ngram_counts(b" " + text.lower().encode("utf-8", "replace").translate(SPACED) + b" ", ORDERS, BITS))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` classes: all splits of up to five, else the widest of random codes."""
    if n <= 5:
        columns = [[1 if c == n - 1 else (1 if (v >> c) & 1 else -1) for c in range(n)] for v in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).reshape(-1, n).T
    rng = np.random.default_rng(7)
    bits = max(15, math.ceil(10 * math.log2(n)))
    best, apart = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        far = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        least = int((far + np.eye(n, dtype=np.int32) * bits).min())
        if least > apart:
            best, apart = code, least
    return best


def train(sample: list[tuple[str, str]]) -> LanguageModel | None:
    """A model of the languages in ``sample`` of (text, language); None where it has none."""
    sample = [(t, y) for t, y in sample if LETTER.search(t)]
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    code = codewords(len(languages))
    x = stacked((features(t) for t, _ in sample), len(sample))
    k = np.searchsorted(languages, [y for _, y in sample])
    share = 1 / np.bincount(k, minlength=len(languages))[k]
    if code.shape[1] == 0:
        return LanguageModel(languages, code, np.zeros(code.shape, np.float32), np.zeros((x.shape[1] + 1, 0), np.float32))
    weights = fit_logistic(x, (code[k] + 1) / 2, share)
    right = ((x @ weights[:-1] + weights[-1]) * code[k] > 0).astype(np.float64)
    trust = np.array([right[k == c].mean(axis=0) for c in range(len(languages))]) + 0.01
    return LanguageModel(languages, code, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32), weights)


def decode(model: LanguageModel, x: np.ndarray) -> np.ndarray:
    """Scores of the languages for rows of features, adding up to 1."""
    f = np.clip(x @ model.weights[:-1] + model.weights[-1], -8, 8)
    loss = np.stack([(model.trust[c] * np.log1p(np.exp(-model.code[c] * f))).sum(axis=1) for c in range(len(model.languages))], axis=1)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: LanguageModel | None, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each whole text.

    A null text or one without a letter is ``und`` with score 0, and so is
    every text where no language was learned.  Equal losses go to the language
    that sorts first.  Repeated rows are predicted again; other columns are not
    read; no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score, near = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            at = [i for i, t in enumerate(texts) if model is not None and LETTER.search(t)]
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                p = decode(model, np.array([features(texts[i]) for i in part], np.float32))
                for i, row in zip(part, p, strict=True):
                    best = int(row.argmax())
                    second = float(np.delete(row, best).max()) if len(row) > 1 else 0.0
                    lang[i], score[i], near[i] = model.languages[best], float(row[best]), float(row[best]) - second < margin
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return texts_with_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learn from rows of ``docs`` that are not held out and have a lang, then predict every row."""
    labels = docs.filter(~held_out()).select("doc_id", F.col("lang").alias("label"))
    return predict(docs, train(labelled_sample(docs, labels, rows_per_language)))
