"""Toxicity: a linear-chain conditional random field that tags toxic words.

Words are runs of word characters in lower case; each is tagged clean or toxic.
A word's emission is the sum of hashed weights of itself, its first and last
three characters and its neighbours; a chain's transitions link adjacent words.
Marginals come from the forward and backward recursions. A document's score is
a logistic function of its largest marginal and of its marginals' sum; its spans
are the character offsets of the words whose marginal is at least one half.

Labelled words come from labelled documents: a word of a toxic document is toxic
if, among the sample's distinct texts, the word stands in toxic ones far more often than
in clean ones, and in several different surroundings there, so that a word that only
near copies of one text share is not taken for toxic; exact copies count once. The field is trained on a
bounded sample of labelled rows, in one task; all texts are scored, and whole.

Cases: a null text counts as empty; a text without words has the score of no
toxic word and no spans; texts of any length are scored whole; repeated rows get
equal scores; with no labelled rows, or none of a class, the score is 0; a null
id is no training row; a document with several labels counts with the smallest;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import WordCodes, labelled_sample, offsets

#: Number of emission weights: a power of two.
DIM = 1 << 20
ROWS_PER_CLASS, MAX_CHARS = 1500, 20_000
EPOCHS, RATE, L2 = 40, 0.5, 1e-4
#: A word is labelled toxic from so many surroundings, and from so large a log ratio of shares.
MIN_PLACES, MIN_LOG_RATIO = 5, 2.0
#: Characters whose chains are run at once.
CHAIN_CHARS = 4_000_000
RESULT = "struct<score: double, spans: array<struct<start: int, end: int, p: double>>>"

_WORD = re.compile(r"\w+")
_KINDS = ("w", "p", "s", "b", "a")  # word, prefix, suffix, word before, word after


def _features(word: str) -> list[int]:
    return [
        zlib.crc32(f"{kind} {part}".encode("utf-8", "surrogatepass")) & (DIM - 1)
        for kind, part in zip(_KINDS, (word, word[:3], word[-3:], word, word))
    ]


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lays chains side by side, the longest first.

    :return: place of each word in the time-major order, chains alive at each step, start of each step.
    """
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max(initial=0))
    alive = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest] if longest else np.zeros(0, np.int64)
    begin = offsets(alive)
    step = np.arange(int(lengths.sum())) - np.repeat(offsets(lengths)[:-1], lengths)
    return begin[step] + np.repeat(rank, lengths), alive, begin


def chain_odds(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic tag at each word.

    Their product is the odds of the marginal.

    :param emission: log odds of each word, chain after chain.
    :param trans: 2 x 2 log weights, from tag to tag.
    """
    place, alive, begin = _time_major(lengths)
    odds = np.empty(len(emission))
    odds[place] = np.exp(np.clip(emission, -40, 40))
    (a00, a01), (a10, a11) = np.exp(trans)
    forward, backward = np.empty(len(odds)), np.empty(len(odds))
    before = None
    for t, n in enumerate(alive):
        e = odds[begin[t] : begin[t] + n]
        before = e if before is None else np.clip(e * (a01 + a11 * before[:n]) / (a00 + a10 * before[:n]), 1e-60, 1e60)
        forward[begin[t] : begin[t] + n] = before
    after = np.zeros(0)
    for t in range(len(alive) - 1, -1, -1):
        here = np.ones(alive[t])
        if len(after):
            e = np.clip(odds[begin[t + 1] : begin[t + 1] + len(after)] * after, 1e-60, 1e60)
            here[: len(after)] = (a10 + a11 * e) / (a00 + a01 * e)
        backward[begin[t] : begin[t] + alive[t]] = here
        after = here
    return forward[place], backward[place]


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    #: Of the logistic function of a document: intercept, and slopes of its two figures.
    link: tuple[float, float, float]


def _figures(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log odds of the largest marginal and log of the marginals' sum, for each chain."""
    out = np.empty((len(lengths), 2))
    out[:, 0], out[:, 1] = 1e-6, 1e-6
    full = lengths > 0
    if full.any():
        starts = offsets(lengths)[:-1][full]
        out[full, 0] = np.maximum.reduceat(p, starts)
        out[full, 1] = np.add.reduceat(p, starts)
    top = np.clip(out[:, 0], 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(np.maximum(out[:, 1], 1e-6))], 1)


def _neighbour_shift(values: np.ndarray, lengths: np.ndarray, back: bool) -> np.ndarray:
    """The value at the word before (or after) each word; 0 where there is none."""
    out = np.zeros(len(values))
    if len(values):
        starts = offsets(lengths)
        full = lengths > 0
        if back:
            out[1:] = values[:-1]
            out[starts[:-1][full]] = 0.0
        else:
            out[:-1] = values[1:]
            out[starts[1:][full] - 1] = 0.0
    return out


def toxic_words(texts: list[list[str]], labels: np.ndarray) -> set[str]:
    """Words that mark toxic documents."""
    # Copies of a text count once, so that no group of them hides or makes a word.
    distinct = list(dict.fromkeys((tuple(words), int(label)) for words, label in zip(texts, labels)))
    n = np.bincount([label for _, label in distinct], minlength=2)
    found = [Counter(), Counter()]
    for words, label in distinct:
        found[label].update(set(words))
    likely = {
        w for w, k in found[1].items()
        if k >= MIN_PLACES and np.log((k + 0.5) / (n[1] + 1)) - np.log((found[0][w] + 0.5) / (n[0] + 1)) >= MIN_LOG_RATIO
    }
    around: dict[str, set] = {w: set() for w in likely}
    for words, label in distinct:
        if label:
            for k, w in enumerate(words):
                if w in likely:
                    around[w].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    # Near copies of a text share both neighbours: as many surroundings as texts are asked for, nearly.
    return {w for w in likely if len(around[w]) >= max(MIN_PLACES, 0.5 * found[1][w])}


def train_field(texts: list[str], labels: np.ndarray, shares: np.ndarray) -> ToxicModel:
    """Trains on documents; ``shares`` are their weights in the documents' logistic function."""
    split = [[w.lower() for w in _WORD.findall(t)] for t in texts]
    marked = toxic_words(split, labels)
    lengths = np.array([len(w) for w in split], np.int64)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for words in split for w in words], np.int64)
    tags = np.array([float(y and w in marked) for words, y in zip(split, labels) for w in words])
    table = np.array([_features(w) for w in index] or np.zeros((0, len(_KINDS))), np.int64)
    weights, bias, trans = np.zeros(DIM), -4.0, np.zeros((2, 2))
    square, bias_square, trans_square = np.full(DIM, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    starts, full = offsets(lengths), lengths > 0
    inner = np.ones(len(ids), bool)  # words with a word after them
    inner[starts[1:][full] - 1] = False
    at = np.flatnonzero(inner)
    here, there = tags[at].astype(int), tags[at + 1].astype(int)
    seen = np.bincount(here * 2 + there, minlength=4).reshape(2, 2).astype(float)
    scale = max(1.0, tags.sum())
    for _ in range(EPOCHS):
        word = weights[table]
        own, as_before, as_after = word[:, :3].sum(1)[ids], word[:, 3][ids], word[:, 4][ids]
        e = own + _neighbour_shift(as_before, lengths, True) + _neighbour_shift(as_after, lengths, False) + bias
        forward, backward = chain_odds(e, lengths, trans)
        odds = forward * backward
        p = odds / (1 + odds)
        miss = (p - tags) / scale
        grad = L2 * weights
        for k, value in enumerate((miss, miss, miss, _neighbour_shift(miss, lengths, False), _neighbour_shift(miss, lengths, True))):
            by_word = np.bincount(ids, value, len(index))
            grad += np.bincount(table[:, k], by_word, DIM)
        # Pairs of tags at adjacent words.
        step = np.exp(np.clip(e[at + 1], -40, 40)) * backward[at + 1]
        joint = np.exp(trans)[:, :, None] * np.stack([np.ones(len(at)), forward[at]])[:, None] * np.stack([np.ones(len(at)), step])[None]
        expected = (joint / joint.sum((0, 1))).sum(2)
        t_grad = (expected - seen) / scale + L2 * trans
        square += grad**2
        trans_square += t_grad**2
        weights -= RATE * grad / np.sqrt(square)
        trans = trans - RATE * t_grad / np.sqrt(trans_square)
        b_grad = miss.sum()
        bias_square += b_grad**2
        bias -= RATE * b_grad / np.sqrt(bias_square)
    x = np.column_stack([np.ones(len(labels)), _figures(p, lengths)])
    link = np.zeros(3)
    share = shares / shares.mean()
    for _ in range(50):  # Newton's steps of a small logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ link, -35, 35)))
        slope = x.T @ (share * (q - labels)) + 1e-2 * link
        curve = (x * (share * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(3)
        link = link - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return ToxicModel(weights, bias, trans, tuple(link.tolist()))


class Tagger:
    """Scores texts with a trained field."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.codes = WordCodes(self._code)

    def _code(self, word: str) -> bytes:
        w = self.model.weights
        rows = [w[_features(t.lower())] for t in _WORD.findall(word)]
        return np.array([(r[0] + r[1] + r[2], r[3], r[4]) for r in rows], "<f4").tobytes()

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, words of each text)."""
        coded = [self.codes.of((t or "").split()) for t in texts]
        lengths = np.array([len(c) // 12 for c in coded], np.int64)
        values = np.frombuffer(b"".join(coded), "<f4").reshape(-1, 3).astype(np.float64)
        e = values[:, 0] + _neighbour_shift(values[:, 1], lengths, True) + _neighbour_shift(values[:, 2], lengths, False) + self.model.bias
        forward, backward = chain_odds(e, lengths, self.model.trans)
        odds = forward * backward
        return odds / (1 + odds), lengths

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        p, lengths = self.tag(texts)
        a, b, c = self.model.link
        figures = _figures(p, lengths)
        scores = 1 / (1 + np.exp(-np.clip(a + figures @ np.array([b, c]), -35, 35)))
        starts = offsets(lengths)
        hot = np.maximum.reduceat(np.append(p, 0.0), starts[:-1]) >= 0.5 if len(texts) else []
        for k, t in enumerate(texts):
            spans = []
            if lengths[k] and hot[k]:
                own = p[starts[k] : starts[k + 1]]
                spans = [(m.start(), m.end(), float(q)) for m, q in zip(_WORD.finditer(t), own) if q >= 0.5]
            yield float(scores[k]), spans


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS,
) -> ToxicModel | None:
    """Trains on a sample of the labelled rows that meet ``train``; None without both classes."""
    sample = labelled_sample(docs, labels, label, train, rows_per_class, max_chars).select(
        "text", "label", "weight", F.xxhash64("doc_id", "text").alias("place")
    )

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["label"].nunique() < 2:
            return pd.DataFrame({"weights": [], "rest": []}, dtype=object)
        rows = rows.sort_values("place", kind="stable")
        m = train_field(rows["text"].tolist(), rows["label"].to_numpy(np.int64), rows["weight"].to_numpy(float))
        return pd.DataFrame({"weights": [m.weights.astype("<f8").tobytes()], "rest": [[m.bias, *m.trans.ravel().tolist(), *m.link]]})

    # A bounded sample, in one task.
    made = sample.groupBy(F.lit(0).alias("all")).applyInPandas(one, "weights binary, rest array<double>").collect()
    if not made:
        return None
    rest = made[0]["rest"]
    return ToxicModel(np.frombuffer(made[0]["weights"], "<f8"), rest[0], np.array(rest[1:5]).reshape(2, 2), tuple(rest[5:]))


def score_column(model: ToxicModel | None, text: Column) -> Column:
    """Score and spans of a column of texts."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)  # DIM weights
    made = []

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if held.value is None:
            return pd.DataFrame({"score": np.zeros(len(texts)), "spans": [[] for _ in texts]})
        if not made:
            made.append(Tagger(held.value))
        rows, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= CHAIN_CHARS:
                rows += made[0].score(part)
                part, size = [], 0
        rows += made[0].score(part)
        return pd.DataFrame({
            "score": [r[0] for r in rows],
            "spans": [[{"start": a, "end": b, "p": q} for a, b, q in r[1]] for r in rows],
        })

    return run(text)
