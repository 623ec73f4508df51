"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts are sequences of words: letters and digits in lower case between white
space, so that case, punctuation and symbols beside a word don't count. An item
and a window of its size may differ in up to ``max_share`` of the item's words,
in edits (insert, delete, replace a word).

A CGK walk embeds a sequence: at each step it puts out the current word and, by a
random bit of step and word, stays or moves on. Sequences a few edits apart then
agree at most steps. A repetition samples ``SAMPLES`` steps of one walk, the first from
its first ``FIRST`` steps, the second from the next ``SECOND`` and the others from
equal parts of the rest; a window whose sampled words all equal an item's is a candidate.
Windows begin at every word of every text near which a leak can be: an edit breaks at most
two of an item's pairs of neighbouring words, so a window with e edits of n words still
has n - 1 - 2 e of them, and places around which fewer pairs of any item stand are left out,
which loses nothing. The walk of a window goes on only while the
words sampled so far equal some item's. Items are
grouped by size (a factor of 1.5), and a group's walk takes two steps for each word
of its smallest item. ``REPETITIONS`` is set
for a recall of 0.98 at ``MAX_SHARE`` itself, an edit in every five words (measured on 600
planted items of each of 8 to 150 words: 0.983 or more there, 0.990 at three in twenty,
0.998 at one in ten). Besides, the first ``MIN_WORDS`` words of each item, or all
of a shorter one, are sought as they are, so that an exact copy is never missed.
A candidate becomes a leak by its exact edit distance to the best window that begins
within ``max_share`` of the item's size from there; every such start is compared.

Items are broadcast in blocks of at most ``BLOCK_WORDS`` words, one pass over the
documents a block.

Cases: a null text has no words and no leak; items without words match nothing,
and items of fewer than ``SHORT`` words are only matched whole and exactly (at the default
share, an edit is more than that of them);
equal items give a row each; repeated documents and null ids give rows of their own;
texts of any length are searched whole; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import WordCodes, offsets

MAX_SHARE = 0.2
SAMPLES, REPETITIONS = 3, 48
#: The first step sampled is one of so many.
FIRST = 6
#: And the second is one of so many after those.
SECOND = 8
#: Words of an item's beginning that are sought as they are; the smallest item that is embedded.
MIN_WORDS, SHORT = 8, 5
BLOCK_WORDS = 500_000
#: Words of documents searched at once.
SEARCH_WORDS = 1_000_000
#: Words whose codes a worker keeps.
MEMO = 400_000
SEED = 20_240_607
_FOUND = "doc_id long, item_id long, first_word long, n_words long, edits int, score double"


def normal(word: str) -> str:
    return word.lower() if word.isalnum() else "".join(c for c in word.lower() if c.isalnum())


def words_of(text: str | None) -> list[str]:
    return [n for w in (text or "").split() if (n := normal(w))]


def best_window(item: np.ndarray, words: np.ndarray, limit: int) -> tuple[int, int] | None:
    """(edits, words taken) of the prefix of ``words`` nearest to ``item``; None beyond ``limit``."""
    size = len(words)
    row = np.arange(size + 1)
    for k, word in enumerate(item, 1):
        step = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        new = np.concatenate(([k], step))
        # An insertion adds one for each word to the right of a cheaper place.
        row = np.minimum.accumulate(new - np.arange(size + 1)) + np.arange(size + 1)
        if row.min() > limit:
            return None
    at = int(np.argmin(row))
    return (int(row[at]), at) if row[at] <= limit else None


def best_start(item: np.ndarray, words: np.ndarray, starts: int, limit: int) -> tuple[int, int] | None:
    """(edits, start) of the window nearest to ``item``, begun at one of the first ``starts`` words; None beyond ``limit``."""
    size, back = len(words), words[::-1]
    place = np.arange(size + 1)
    row = np.zeros(size + 1, np.int64)  # from the end: a window may end anywhere
    for k, word in enumerate(item[::-1], 1):
        step = np.minimum(row[:-1] + (back != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([k], step)) - place) + place
        if row.min() > limit:
            return None
    by_start = row[::-1][:starts]
    at = int(np.argmin(by_start))
    return (int(by_start[at]), at) if by_start[at] <= limit else None


@dataclass
class _Group:
    """Items of about one size, in one repetition."""

    steps: np.ndarray  # sampled steps, ascending
    member: np.ndarray  # by code: whether some item's first sampled word
    prefixes: list[np.ndarray]  # sorted keys of the items' first 1, 2, ... sampled words
    items: dict[int, list[int]]  # whole key -> items


class Index:
    """Items of a block, embedded."""

    def __init__(self, items: list[tuple[int, list[str]]], max_share: float, repetitions: int, samples: int):
        self.max_share = max_share
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int64) for _, words in items]
        self.members = [frozenset(x.tolist()) for x in self.items]
        # Code 0 ends a text, 1 is any word that no item has.
        self.n_codes = len(self.vocabulary) + 2
        self.codes = WordCodes(lambda w: self.vocabulary.get(n, 1).to_bytes(4, "little") if (n := normal(w)) else b"", MEMO)
        random = np.random.default_rng(SEED)
        sizes = np.array([len(x) for x in self.items], np.int64)
        #: Key of a first sampled word, by its code.
        self.first_keys = _next_key(np.uint64(0), np.arange(self.n_codes))
        self.repetitions: list[tuple[np.ndarray, list[_Group], np.ndarray]] = []
        bounds, groups = [], []
        for size in np.unique(sizes[sizes >= SHORT]):
            if not bounds or size > bounds[-1] * 1.5:
                bounds.append(int(size))
                groups.append([])
            groups[-1] += np.flatnonzero(sizes == size).tolist()
        #: For each group: words to look back and ahead of a start, and the pairs of items that must stand there.
        self.reach = []
        for members in groups:
            n = sizes[members]
            edits = (max_share * n).astype(np.int64)
            self.reach.append((int(edits.max()), int((n + 2 * edits).max()), int((n - 1 - 2 * edits).min())))
        pairs = [x[:-1] * self.n_codes + x[1:] for x, n in zip(self.items, sizes) if n >= SHORT]
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.pair_bits = min(24, max(16, int(16 * len(pairs)).bit_length()))
        #: By hash: whether a pair of neighbouring words may be some item's.
        self.pair_member = np.zeros(1 << self.pair_bits, bool)
        self.pair_member[self._pair_place(pairs)] = True
        # Exact copies: every word of a short item, the first words of a longer one.
        onward = np.ones((MIN_WORDS, self.n_codes), np.int8)
        onward[:, 0] = 0
        heads = np.minimum(sizes, MIN_WORDS)
        made = [self._group(onward, np.arange(n), np.flatnonzero(heads == n).tolist()) for n in np.unique(heads[heads > 0])]
        self.exact = (onward, made, self._member(made))
        for repetition in range(repetitions if bounds else 0):
            moves = random.integers(0, 2, (2 * max(bounds), self.n_codes)).astype(np.int8)
            moves[:, 0] = 0
            # Walks of a family share their first steps, so that each goes on from the one before it.
            if repetition % FIRST:
                moves[:FIRST] = self.repetitions[-1][0][:FIRST]
            made = []
            for least, members in zip(bounds, groups):
                # The first step sampled comes early and is the same for all groups: most windows end there.
                # The second follows soon, for the same reason.
                edges = np.concatenate(([FIRST], np.linspace(FIRST + SECOND, 2 * least, samples - 1))).astype(int)
                # The walk of a short item ends before the last parts begin: it has fewer samples.
                parts = [(a, max(a + 1, min(b, 2 * least))) for a, b in zip(edges, edges[1:]) if a < 2 * least]
                steps = np.unique([repetition % FIRST, *(int(random.integers(a, b)) for a, b in parts)])
                made.append(self._group(moves, steps, members))
            self.repetitions.append((moves, made, self._member(made)))

    def _member(self, groups: list[_Group]) -> np.ndarray:
        member = np.zeros(self.n_codes, bool)
        for group in groups:
            member |= group.member
        return member

    def _group(self, moves: np.ndarray, steps: np.ndarray, members: list[int]) -> _Group:
        keys = np.zeros((len(members), len(steps)), np.uint64)
        for m, item in enumerate(members):
            codes, at, key, k = np.append(self.items[item], 0), 0, np.uint64(0), 0
            for step in range(int(steps[-1]) + 1):
                code = codes[min(at, len(codes) - 1)]
                if step == steps[k]:
                    key = _next_key(key, code)
                    keys[m, k] = key
                    k += 1
                at += int(moves[step, code])
        by_key: dict[int, list[int]] = {}
        for m, item in enumerate(members):
            by_key.setdefault(int(keys[m, -1]), []).append(item)
        prefixes = [np.unique(keys[:, k]) for k in range(len(steps))]
        return _Group(steps, np.isin(self.first_keys, prefixes[0]), prefixes, by_key)

    def _pair_place(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def able(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each group, whether enough pairs of items stand around each word for a window of the group."""
        known = codes > 1
        at = np.flatnonzero(known[:-1] & known[1:])
        pairs = codes[at].astype(np.int64) * self.n_codes + codes[at + 1]
        marks = np.zeros(len(codes), np.int32)
        marks[at[self.pair_member[self._pair_place(pairs)]]] = 1
        below = offsets(marks)
        place = np.arange(len(codes))
        return [
            below[np.minimum(place + ahead, len(codes))] - below[np.maximum(place - back, 0)] >= least for back, ahead, least in self.reach
        ]

    def candidates(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(first word, item) for texts one after the other, each ended by code 0."""
        found: set[tuple[int, int]] = set()
        if not self.repetitions:
            return found
        able = self.able(codes)
        starts = np.flatnonzero((codes != 0) & np.logical_or.reduce(able)).astype(np.int32)
        able = [a[starts] for a in able]
        word, move = np.empty(len(starts), codes.dtype), np.empty(len(starts), np.int8)
        for repetition, (moves, groups, member) in enumerate(self.repetitions):
            if repetition % FIRST == 0:
                at, done = starts.copy(), 0
            first = int(groups[0].steps[0])
            for step in range(done, first):
                np.take(codes, at, out=word, mode="clip")
                np.take(moves[step], word, out=move, mode="clip")
                at += move
            done = first
            np.take(codes, at, out=word, mode="clip")
            # Most windows end here: their word is no item's.
            some = np.flatnonzero(member.take(word))
            some_at, some_word = at[some], word[some]
            for group, near in zip(groups, able):
                own = near[some]
                for left, whole in zip(*self._walked(codes, moves, group, some[own], some_at[own], some_word[own])):
                    found.update((int(starts[left]), item) for item in group.items.get(int(whole), ()))
        return found

    def copies(self, codes: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(first word, item) of the exact beginnings of items; of short items the first in each text."""
        found: set[tuple[int, int]] = set()
        moves, groups, member = self.exact
        starts = np.flatnonzero(member.take(codes)).astype(np.int32)
        for group in groups:
            left, keys = self._walked(codes, moves, group, starts, starts, codes[starts])
            if len(group.steps) < MIN_WORDS and len(left):
                # Nothing is left to compare: the first place in a text is its best window.
                text = np.searchsorted(begin, left, "right")
                order = np.lexsort((left, keys, text))
                left, keys, text = left[order], keys[order], text[order]
                new = np.ones(len(left), bool)
                new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
                left, keys = left[new], keys[new]
            for first, whole in zip(left.tolist(), keys.tolist()):
                found.update((first, item) for item in group.items.get(whole, ()))
        return found

    def _walked(
        self, codes: np.ndarray, moves: np.ndarray, group: _Group, left: np.ndarray, at: np.ndarray, word: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(windows, keys) whose sampled words are an item's, of windows ``left`` that stand at ``at`` on ``word``."""
        mine = np.flatnonzero(group.member[word])
        left, own, own_word = left[mine], at[mine], word[mine]
        key, k = self.first_keys[own_word], 1
        first = int(group.steps[0])
        for s in range(first, int(group.steps[-1]) + 1):
            if s > first:
                own_word = codes[own]
            if k < len(group.steps) and s == group.steps[k]:
                key = _next_key(key, own_word)
                place = np.searchsorted(group.prefixes[k], key)
                kept = group.prefixes[k][np.minimum(place, len(group.prefixes[k]) - 1)] == key
                left, own, key, own_word = left[kept], own[kept], key[kept], own_word[kept]
                k += 1
                if not len(left):
                    break
            own = own + moves[s][own_word]
        return left, key

    def leaks(self, codes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits): the best window of each item in each text."""
        # Places where a window of the item may begin: a few words off a candidate's.
        places: dict[tuple[int, int], list[list[int]]] = {}
        for first, item in sorted(self.candidates(codes) | self.copies(codes, begin)):
            own = self.items[item]
            limit = int(self.max_share * len(own)) if len(own) >= SHORT else 0
            text = int(np.searchsorted(begin, first, "right")) - 1
            end = int(begin[text + 1]) - 1
            low, high = max(int(begin[text]), first - limit), min(end, first + limit + 1)
            nearby = codes[low : min(end, first + len(own) + 2 * limit)]
            if sum(map(self.members[item].__contains__, nearby.tolist())) < len(own) - limit:
                continue  # too few of the item's words for any window here
            ranges = places.setdefault((text, item), [])
            if ranges and low <= ranges[-1][1]:
                ranges[-1][1] = max(high, ranges[-1][1])
            else:
                ranges.append([low, high])
        for (text, item), ranges in places.items():
            own, best = self.items[item], None
            limit = int(self.max_share * len(own)) if len(own) >= SHORT else 0
            for low, high in ranges:
                words = codes[low : min(int(begin[text + 1]) - 1, high - 1 + len(own) + limit)]
                near = best_start(own, words, high - low, limit)
                if near and (best is None or near[0] < best[0]):
                    best, limit = (near[0], low + near[1]), near[0]
            if best:
                n = best_window(own, codes[best[1] : min(int(begin[text + 1]) - 1, best[1] + len(own) + limit)], limit)[1]
                yield text, item, best[1] - int(begin[text]), n, best[0]


def _next_key(key: np.ndarray | np.uint64, code: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.asarray(key, np.uint64) + np.asarray(code).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", max_share: float = MAX_SHARE,
    repetitions: int = REPETITIONS, samples: int = SAMPLES, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits, score): benchmark items in documents.

    ``first_word`` and ``n_words`` give the nearest window among the text's words;
    ``score`` is one less the edits' share of the item's words.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sized = items.withColumn("n", F.size(F.split(F.trim("text"), r"\s+"))).where(F.col("text").isNotNull())
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_words))  # twice as many, for blocks dealt by hash are uneven
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for block in range(n_blocks):
        part = items.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block))
        rows = [(r["item_id"], words_of(r["text"])) for r in part.orderBy("item_id", "text").collect()]  # about block_words words
        rows = [r for r in rows if r[1]]
        if not rows and block + 1 < n_blocks:
            continue
        held = spark.sparkContext.broadcast(rows)
        found = source.mapInArrow(_searcher(held, max_share, repetitions, samples), _FOUND)
        out = found if out is None else out.unionAll(found)
    return out


def _searcher(held, max_share: float, repetitions: int, samples: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held.value:
            return
        index = Index(held.value, max_share, repetitions, samples)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            done, coded, n = 0, [], 0
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or "").split()
                coded.append(np.frombuffer(index.codes.of(words) + b"\0\0\0\0", "<i4"))
                n += len(coded[-1])
                if n >= SEARCH_WORDS or k + 1 == batch.num_rows:
                    begin = offsets(np.array([len(c) for c in coded], np.int64))
                    rows = list(index.leaks(np.concatenate(coded), begin))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([done + r[0] for r in rows], pa.int64())),
                            pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                            pa.array([r[4] for r in rows], pa.int32()),
                            pa.array([1 - r[4] / len(index.items[r[1]]) for r in rows], pa.float64()),
                        ],
                        ["doc_id", "item_id", "first_word", "n_words", "edits", "score"],
                    )
                    done, coded, n = k + 1, [], 0

    return search
