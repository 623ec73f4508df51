"""Ranked lexical search: branch and bound over FP-trees of documents.

A document is restricted to the terms that some item holds, in the order of the terms'
document frequency, the most frequent first; documents whose vectors begin alike share a
path of a trie. Subtrees of at most ``LEAF`` documents are pages; paths without a
branch are one step, and small neighbouring branches share a page. Each subtree keeps the
largest tf of each of its terms and the least m of its documents. As a term's part of a score
grows with tf and falls with m, they bound the score of every document below. For each
item the tree is searched depth first, the best branch first; a branch whose bound is below
the item's ``k``-th best score so far is left out.

Three passes over the documents: terms become vectors, which are written; counts are taken
from them (N, L and each term's df, over all documents); each task makes trees of ``PART``
documents from its share of the vectors and searches all items in each, keeping its best
for the next tree. Tasks send on at most ``k`` rows an item. Items come in blocks of about
``BLOCK_TERMS`` terms, broadcast, searched, written and released one by one; an item is never
split, so one of more terms is a block of its own.

Terms are runs of letters, digits and characters beyond ASCII, lower-cased in A-Z alone.
Scores are 64-bit integers; see ``score_parts`` for the formula.

Cases: a null or empty text has no terms and counts for nothing; texts of any length are read
whole; repeated rows are documents of their own; a document without an id counts in N, L
and df but isn't ranked; equal scores go to the smaller id; rows of one item id are one
item with the terms of all its texts; an item without an id, or without terms that
documents hold, has no rows; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import offsets, saved
from rewardloom.session import scratch_table_path

#: Documents of a tree and of a page, terms of a block of items, terms looked up at once.
PART, LEAF, BLOCK_TERMS, SLICE = 4096, 128, 500_000, 2_000_000
_VECTORS = "doc_id long, n long, codes array<int>, tfs array<int>"
#: A term's part of a score is below this.
_PART_LIMIT = 10**6
_LARGEST = np.iinfo(np.int64).max
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, given in UTF-8."""
    return text.translate(_TABLE).split()


def score_parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m): a term's part of a score, before its weight."""
    return (10**9 * tf) // (1000 * tf + 20 * m)


def lengths_m(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """50 + (50 n N) div L of documents of n terms."""
    if int(n.max(initial=0)) * 50 * docs < 1 << 63:
        return 50 + (50 * docs * n) // total
    return np.array([50 + 50 * int(x) * docs // total for x in n], np.int64)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Tree:
    """The trie of some documents, paged, with the bounds of its subtrees.

    :param begin: where each document's entries begin in ``terms`` and ``tfs``; a document's
        terms ascend. The smaller a term, the more frequent.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, begin: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        raw, cuts = terms.astype(">u4").tobytes(), (4 * begin).tolist()
        paths = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        order = sorted(range(len(paths)), key=paths.__getitem__)  # the order of depth-first paths
        self.ids, self.n_terms = ids[order], n_terms
        m, size = m[order], np.diff(begin)[order]
        doc = np.repeat(np.arange(len(order)), size)
        start = offsets(size)
        at = np.arange(len(terms)) - start[doc] + begin[:-1][order][doc]
        terms, tfs = terms[at].astype(np.int64), tfs[at].astype(np.int64)
        self._split([paths[i] for i in order], start, terms)
        self._bound(start, doc, terms, tfs, m)

    def _split(self, paths: list[bytes], start: np.ndarray, terms: np.ndarray) -> None:
        """Pages as ranges of documents; ``children`` is None for those that hold documents."""
        self.low, self.high, self.children = [0], [len(paths)], [None]
        todo = [0]
        while todo:
            page = todo.pop()
            low, high = self.low[page], self.high[page]
            first, last = paths[low], paths[high - 1]
            if high - low <= LEAF or first == last:
                continue
            depth = _shared(first, last)
            # Documents that end here come first; the others by their next term.
            follows = np.where(np.diff(start[low : high + 1]) > depth, terms[np.minimum(start[low:high] + depth, len(terms) - 1)], -1)
            cuts = [0, *(np.flatnonzero(np.diff(follows)) + 1).tolist(), high - low]
            own, held = [], 0
            for a, b in zip(cuts, cuts[1:]):
                if held and held + b - a <= LEAF:  # a neighbour of the small branch before it
                    self.high[own[-1]] += b - a
                    held += b - a
                    continue
                own.append(len(self.low))
                self.low.append(low + a)
                self.high.append(low + b)
                self.children.append(None)
                held = b - a if b - a <= LEAF else 0
            self.children[page] = own
            todo += own

    def _bound(self, start: np.ndarray, doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> None:
        """Every page's entries: for its documents their parts of a score, for its branches the largest that any document below may have."""
        exact = score_parts(tfs, m[doc])
        largest: list = [None] * len(self.low)  # (terms, largest tf) of the subtree
        least = np.zeros(len(self.low), np.int64)
        keys, members, values = [], [], []
        for page in range(len(self.low) - 1, -1, -1):  # branches come before what holds them
            low, high = self.low[page], self.high[page]
            least[page] = m[low:high].min()
            if self.children[page] is None:
                a, b = start[low], start[high]
                entry, value, member, tf = terms[a:b], exact[a:b], doc[a:b] - low, tfs[a:b]
            else:
                below = [largest[c] for c in self.children[page]]
                entry, tf = (np.concatenate(x) for x in zip(*below))
                member = np.repeat(np.arange(len(below)), [len(t) for t, _ in below])
                value = score_parts(tf, least[self.children[page]][member])
                for c in self.children[page]:
                    largest[c] = None
            order = np.argsort(entry, kind="stable")
            entry, tf = entry[order], tf[order]
            first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if len(entry) else np.zeros(0, np.int64)
            largest[page] = (entry[first], np.maximum.reduceat(tf, first) if len(first) else tf)
            keys.append(page * self.n_terms + entry)
            members.append(member[order])
            values.append(value[order])
        keys = np.concatenate(keys[::-1])
        self.members, self.values = np.concatenate(members[::-1]), np.concatenate(values[::-1])
        self.runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.run_ends = keys[self.runs], np.r_[self.runs[1:], len(keys)]

    def _sums(self, page: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sums of a page's entries by member: scores, or bounds of branches."""
        size = self.high[page] - self.low[page] if self.children[page] is None else len(self.children[page])
        wanted = page * self.n_terms + terms
        run = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        there = self.keys[run] == wanted
        run, own = run[there], weights[there]
        count = self.run_ends[run] - self.runs[run]
        ends = np.cumsum(count)
        at = np.repeat(self.runs[run] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        parts = np.repeat(own, count) * self.values[at]
        if int(own.sum()) * _PART_LIMIT < 1 << 53:  # then doubles hold the sums exactly
            return np.bincount(self.members[at], parts, size).astype(np.int64)
        out = np.zeros(size, np.int64)
        np.add.at(out, self.members[at], parts)
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the tree's best documents to ``best``; returns the number of pages opened."""
        todo, opened = [(_LARGEST, 0)], 0
        while todo:
            bound, page = todo.pop()
            if bound < best.least:
                continue
            opened += 1
            sums = self._sums(page, terms, weights)
            able = np.flatnonzero(sums >= best.least)
            if self.children[page] is None:
                best.add(sums[able], self.ids[self.low[page] + able])
            else:
                able = able[np.argsort(sums[able], kind="stable")]  # the best branch is taken first
                todo += [(int(sums[c]), self.children[page][c]) for c in able.tolist()]
        return opened


def _shared(a: bytes, b: bytes) -> int:
    """How many terms two paths begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint32, n // 4) != np.frombuffer(b, np.uint32, n // 4))
    return int(differ[0]) if len(differ) else n // 4


class Best:
    """An item's ``k`` best (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # scores above 0
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


@dataclass(frozen=True)
class Items:
    """One block of items, as the tasks get it."""

    #: Rank of each code by document frequency, the most frequent first.
    rank: np.ndarray
    #: Each item's ranks, ascending, and their weights.
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    docs: int
    total: int


def _with_terms(rows: DataFrame, name: str) -> DataFrame:
    """(name, term): the distinct terms of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            terms = pa.array([t.decode("utf-8", "replace") for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(row)), terms], [name, "term"])

    kind = rows.schema[name].dataType.simpleString()
    return rows.mapInArrow(run, f"{name} {kind}, term string")


def _vectors(docs: DataFrame, held) -> DataFrame:
    """Each text's number of terms, and the codes and tfs of those that items hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {t.encode(): k for k, t in enumerate(held.value, 1)}  # from 1, so that 0 is none
        span = len(code) + 1
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            n, sizes, coded, at = [], [], [], 0
            for k in range(batch.num_rows):
                terms = terms_of(texts[k].as_py() or b"")
                n.append(len(terms))
                held_here = list(filter(None, map(code.get, terms)))
                sizes.append(len(held_here))
                coded += held_here
                if len(coded) >= SLICE or k + 1 == batch.num_rows:
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    keys, tfs = np.unique(doc * span + np.array(coded, np.int64), return_counts=True)
                    doc, own = np.divmod(keys, span)
                    cuts = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (own - 1, tfs)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "codes", "tfs"])
                    n, sizes, coded, at = [], [], [], k + 1

    return docs.mapInArrow(run, _VECTORS)


def _searcher(held, k: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        best = [Best(k) for _ in items.terms]
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            kept.append(_arrays(batch, items))
            while sum(len(x[0]) for x in kept) >= part:
                whole = _joined(kept)
                _search_tree(_cut(whole, 0, part), items, best)
                kept = [_cut(whole, part, len(whole[0]))]
        if kept:
            _search_tree(_joined(kept), items, best)
        number = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        columns = [pa.array(number, pa.int32())] + [pa.array(np.concatenate([getattr(b, c) for b in best] or [np.zeros(0, np.int64)]), pa.int64()) for c in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays(columns, ["number", "doc_id", "score"])

    return run


def _arrays(batch: pa.RecordBatch, items: Items) -> tuple[np.ndarray, ...]:
    """(ids, m, entries of each, ranks, tfs) of a batch of vectors, each vector's ranks ascending."""
    lists = batch.column("codes")
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    ranks, tfs = items.rank[lists.flatten().to_numpy()], batch.column("tfs").flatten().to_numpy()
    order = np.lexsort((ranks, np.repeat(np.arange(len(size)), size)))
    return batch.column("doc_id").to_numpy(), lengths_m(batch.column("n").to_numpy(), items.docs, items.total), size, ranks[order], tfs[order]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _cut(part: tuple[np.ndarray, ...], a: int, b: int) -> tuple[np.ndarray, ...]:
    ids, m, size, ranks, tfs = part
    begin = offsets(size)
    return ids[a:b], m[a:b], size[a:b], ranks[begin[a] : begin[b]], tfs[begin[a] : begin[b]]


def _search_tree(part: tuple[np.ndarray, ...], items: Items, best: list[Best]) -> None:
    ids, m, size, ranks, tfs = part
    if not len(ids):
        return
    tree = Tree(ids, m, offsets(size), ranks, tfs, len(items.rank))
    for terms, weights, own in zip(items.terms, items.weights, best):
        tree.search(terms, weights, own)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS, part: int = PART,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    pairs = saved(_with_terms(asked.where("item_id is not null and text is not null"), "item_id").distinct(), "item-terms")
    n_pairs = pairs.count()
    blocks = -(-2 * n_pairs // block_terms) if n_pairs > block_terms else 1  # blocks dealt by hash are uneven
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    names = items.select(F.col(item_id).alias("item_id"))
    schema = names.schema.simpleString()[len("struct<") : -1].replace(":", " ", 1) + ", rank int, doc_id long, score long"
    out = scratch_table_path(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(out)
    for number in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).orderBy("item_id", "term").collect()  # one block
        if own:
            found = _ranked_block(texts, [(r["item_id"], r["term"]) for r in own], k, part)
            named = spark.createDataFrame(list(enumerate(dict.fromkeys(r["item_id"] for r in own))), f"at int, {schema.split(',')[0]}")
            found.join(named, F.col("number") == F.col("at")).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _ranked_block(texts: DataFrame, own: list[tuple], k: int, part: int) -> DataFrame:
    """(number, rank, doc_id, score) for the items of one block, numbered as they come in ``own``."""
    spark = texts.sparkSession
    vocabulary = sorted({t for _, t in own})
    held = spark.sparkContext.broadcast(vocabulary)
    vectors = saved(_vectors(texts, held), "restricted-vectors")
    held.unpersist()
    sums = vectors.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("total")).first()
    docs, total = sums["docs"] or 0, sums["total"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():  # one row a term of the block
        df[r["code"]] = r["df"]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(vocabulary))
    code = {t: c for c, t in enumerate(vocabulary)}
    of_item: dict = {}
    for item, term in own:
        of_item.setdefault(item, []).append(code[term])
    terms, weights = [], []
    for codes in of_item.values():
        codes = np.array([c for c in codes if df[c]], np.int64)
        codes = codes[np.argsort(rank[codes])]
        terms.append(rank[codes])
        weights.append(np.array([weight(docs, int(df[c])) for c in codes], np.int64))
    held = spark.sparkContext.broadcast(Items(rank, terms, weights, docs, max(total, 1)))
    ranked = vectors.where("doc_id is not null and size(codes) > 0").mapInArrow(_searcher(held, k, part), "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
