"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL.

A text's tokens are its runs of word characters and its runs of other characters
that are no white space, in their own case. Features are the hashes of its n-grams of
one and two tokens, weighted by the logarithm of their count and scaled to unit
length, and of three marks of the whole text: tenths of repeated bigrams, the power
of two of its length, and the tenths of tokens that are not words. The score is the
logistic function of the sparse dot product of features and weights.

Training follows the regularised leader, one example after the other, in
``SHARDS`` shards of a bounded sample of labelled rows at once; the weights are
the mean over the shards. All texts are scored, and whole.

Cases: a null text counts as empty, an empty text is scored from the marks alone;
texts of any length are scored whole; repeated rows get equal scores; with no
labelled rows the score is one half; a null id is no training row; a document
with several labels counts with the smallest; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import WordCodes, labelled_sample

#: Number of weights: a power of two.
DIM = 1 << 18
SHARDS = 4
ROWS_PER_CLASS, MAX_CHARS, EPOCHS = 3000, 20_000, 12
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MARK_VALUE = 0.5


class Features:
    """Hashed features of texts."""

    def __init__(self):
        self.codes = WordCodes(self._code)

    @staticmethod
    def _code(word: str) -> bytes:
        # The lowest bit says whether the token is a word.
        return np.array(
            [zlib.crc32(t.encode("utf-8", "surrogatepass")) & ~1 | t[0].isalnum() for t in _TOKEN.findall(word)], "<u4"
        ).tobytes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, values), places ascending and distinct."""
        one = np.frombuffer(self.codes.of((text or "").split()), "<u4").astype(np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        n = len(one)
        again = 1 - len(np.unique(two)) / len(two) if len(two) else 0.0
        words = float((one & np.uint64(1)).mean()) if n else 0.0
        marks = [f"again {int(again * 10)}", f"long {n.bit_length()}", f"other {int((1 - words) * 10)}"]
        grams = np.concatenate([(one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40), two]) & np.uint64(DIM - 1)
        places, counts = np.unique(grams.astype(np.int64), return_counts=True)
        values = np.log1p(counts)
        values /= np.sqrt((values**2).sum()) if n else 1.0
        at = np.array([zlib.crc32(m.encode()) & (DIM - 1) for m in marks], dtype=np.int64)
        places, back = np.unique(np.concatenate([places, at]), return_inverse=True)
        return places, np.bincount(back, np.concatenate([values, np.full(len(at), _MARK_VALUE)]), len(places))


def train_ftrl(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, intercept) after FTRL-proximal updates in the given order."""
    features = Features()
    rows = [features.of(t) for t in texts]
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - np.where(at == DIM, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(at == DIM, 0.0, L2))

    share = weights / weights.mean()
    for _ in range(epochs):
        for (places, values), y, s in zip(rows, labels, share):
            at, x = np.append(places, DIM), np.append(values, 1.0)
            w = weight(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = s * (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    final = weight(np.arange(DIM + 1))
    return final[:DIM], float(final[DIM])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    intercept: float


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality",
    rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS, shards: int = SHARDS,
) -> QualityModel:
    """Trains on a sample of the labelled rows that meet ``train``."""
    sample = labelled_sample(docs, labels, label, train, rows_per_class, max_chars)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        weights, intercept = train_ftrl(rows["text"].tolist(), rows["label"].to_numpy(float), rows["weight"].to_numpy(float))
        return pd.DataFrame({"rows": [len(rows)], "weights": [weights.astype("<f8").tobytes()], "intercept": [intercept]})

    place = F.xxhash64("doc_id", "text")
    dealt = sample.select("text", "label", "weight", place.alias("place"), F.pmod(place, F.lit(shards)).alias("shard"))
    parts = dealt.groupBy("shard").applyInPandas(one, "rows long, weights binary, intercept double").collect()  # a model a shard
    if not parts:
        return QualityModel(np.zeros(DIM), 0.0)
    size = np.array([p["rows"] for p in parts], float)
    weights = np.average([np.frombuffer(p["weights"], "<f8") for p in parts], axis=0, weights=size)
    return QualityModel(weights, float(np.average([p["intercept"] for p in parts], weights=size)))


def score_column(model: QualityModel, text: Column) -> Column:
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)  # DIM weights
    made = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Features())
        model = held.value
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            places, values = made[0].of(t)
            out[k] = model.weights[places] @ values
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out + model.intercept, -35, 35))))

    return run(text)
