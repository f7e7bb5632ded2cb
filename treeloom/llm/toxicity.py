"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
Each window of a text is compressed with both; the bytes that the toxic
dictionary saves are its distance.  How many windows save how much, calibrated
against labels, gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .learning import fit_logistic, held_out, labelled_sample, texts_with_id

#: Bytes of the common dictionary and of either class's own.
BASE_BYTES, OWN_BYTES = 512, 2048
#: Bytes of the substrings that tell toxic windows from ordinary ones.
SHINGLE = 6
#: A substring marks windows if its share of toxic texts is so many times that of ordinary ones.
LIFT = 4.0
#: Saved bytes of a window are told apart in this range.
LEAST, MOST = -4, 9
#: Saved bytes from which a window counts as marked, a feature each.
STEPS = (2, 3, 4, 6)
THRESHOLD = 0.7
#: Both dictionaries end with this text and it follows every window: a frame always holds a match, and no
#: window lies in the last bytes of a frame, where the compressor does not search.
PRIMER = b" the of and to in is that "
MEMO_ENTRIES = 400_000
ROWS_PER_CLASS = 2500


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    odds: np.ndarray  # log-odds of a toxic text for each number of saved bytes of a window
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def windows(text: str) -> list[bytes]:
    """The windows of a text: its words in lower case, with a space on either side."""
    return [f" {w} ".encode("utf-8", "replace") for w in text.lower().split()]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=14, hash_log=13, search_log=6, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
        write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Distance:
    """Bytes that the toxic dictionary saves on a window, remembered for recent windows."""

    def __init__(self, model: ToxicityModel) -> None:
        self.ordinary, self.toxic, self.odds = _compressor(model.ordinary), _compressor(model.toxic), model.odds
        self.memo: dict[bytes, int] = {}

    def __call__(self, window: bytes) -> int:
        saved = self.memo.get(window)
        if saved is None:
            data = window + PRIMER
            saved = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
            if len(window) <= 64:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[window] = saved
        return saved

    def histogram(self, text: str) -> np.ndarray:
        """How many windows of a text save how many bytes."""
        out = np.zeros(MOST - LEAST + 1)
        for saved, n in Counter(map(self, windows(text))).items():
            out[min(max(saved, LEAST), MOST) - LEAST] += n
        return out

    def features(self, text: str) -> list[float]:
        held = self.histogram(text)
        n = held.sum()
        odds = float(held @ self.odds)
        over = [held[t - LEAST :].sum() for t in STEPS]
        return [np.sign(odds) * np.log1p(abs(odds)), odds / np.sqrt(n + 1), odds / (n + 1)] + [np.log1p(c) for c in over] + [np.sqrt(c / (n + 1)) for c in over] + [np.log1p(n)]


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary's content, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _marked(window: bytes, marks: set[bytes]) -> list[bytes]:
    """The stretches of a window that marking substrings cover, and a byte more."""
    covered = np.zeros(len(window) + 2, np.int8)
    for i in range(len(window) - SHINGLE + 1):
        if window[i : i + SHINGLE] in marks:
            covered[i + 1 : i + 1 + SHINGLE] = 1
    edges = np.flatnonzero(np.diff(covered))
    return [window[a : b + 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def train(sample: list[tuple[str, str]]) -> ToxicityModel | None:
    """A model from (text, "0" or "1"); None where either class is missing."""
    texts = [(windows(t), y == "1") for t, y in sample]
    n_toxic = sum(y for _, y in texts)
    if not n_toxic or n_toxic == len(texts):
        return None
    held: tuple[Counter, Counter] = Counter(), Counter()
    for own, toxic in texts:
        held[toxic].update({w[i : i + SHINGLE] for w in set(own) for i in range(len(w) - SHINGLE + 1)})
    least = max(3, 0.02 * n_toxic)
    share = n_toxic / (len(texts) - n_toxic)
    marks = {s for s, c in held[True].items() if c >= least and c >= LIFT * share * (held[False][s] + 0.5)}
    toxic = [s for own, y in texts if y for w in own for s in _marked(w, marks)]
    ordinary = [w for own, y in texts if not y for w in own]
    if not toxic or not ordinary:
        return None
    rng = np.random.default_rng(1)
    joined = lambda of, n: [b"".join(of[i] for i in rng.integers(0, len(of), 12)) for _ in range(n)]
    own = _trained(joined(toxic, 4000), OWN_BYTES, 32, 6)
    other = _trained(joined(ordinary, 4000), OWN_BYTES, 32, 6)
    base = _trained(joined(ordinary, 4000), BASE_BYTES, 50, 8)
    size = min(len(own), len(other))  # of one length, so that distances to common matches are the same
    model = ToxicityModel(base + other[-size:] + PRIMER, base + own[-size:] + PRIMER, np.zeros(MOST - LEAST + 1), np.zeros(0), np.zeros(0), np.zeros(0))
    distance = Distance(model)
    held = [np.ones(MOST - LEAST + 1), np.ones(MOST - LEAST + 1)]
    for (t, _), (_, y) in zip(sample, texts, strict=True):
        own = distance.histogram(t)
        held[y] += own / max(1.0, np.sqrt(own.sum()))  # long texts count for more, but not by their length
    distance.odds = model.odds = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())
    x = np.array([distance.features(t) for t, _ in sample], np.float32)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights = fit_logistic((x - model.mean) / model.spread, np.array([y for _, y in texts]), rounds=2000, rate=1.0)[:, 0]
    return model


def score(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold``) for each whole text.

    A null text counts as empty and is scored as a text without windows; where
    no model could be learned every score is 0.  Repeated rows are scored
    again; other columns are not read; no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = None if model is None else Distance(model)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if distance is None or not texts:
                p = np.zeros(len(texts))
            else:
                x = (np.array([distance.features(t) for t in texts]) - model.mean) / model.spread
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return texts_with_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Learn from ``labels`` (doc_id, toxic) that are not held out, then score every row of ``docs``."""
    known = labels.filter(~held_out()).selectExpr("doc_id", "toxic as label")
    return score(docs, train(labelled_sample(docs, known, rows_per_class)))
