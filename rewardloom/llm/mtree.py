"""Exact top-k by inner product: best-first search of M-trees.

The inner product becomes a metric by one more dimension: with ``M`` the largest
norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0);
then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so near means a high product.

Vectors are dealt by hash into parts of about ``PART`` vectors, and each part is
bulk-loaded into an M-tree of pages, written as one row a page: a routing
entry has a pivot, a covering radius and its distance to the parent's pivot; a
leaf entry has a vector and its distance to the leaf's pivot. A search keeps the
pages in a heap by the least distance that any of their vectors may have. Before a
distance to an entry is computed, the stored distance to the parent gives a lower
bound by the triangle inequality, and an entry beyond the k-th best is left out.
Distances only steer; scores are exact integer products. Bounds allow for the
rounding of distances, so no vector that could tie is left out.

Equal vectors of a part are one leaf entry with its ids ascending, so that many
copies of a vector don't fill pages. Queries are broadcast in blocks of at most
``QUERY_BLOCK``, each a pass over the pages whose results are written before the next
block is collected; a part is read by one task.

Cases: null vectors, and vectors with null or non-finite components, take no part;
so do those whose length differs from ``dim``, if that is given, or else from the
most common length (a tie takes the longer); a null id takes no part; rows with the
same id are candidates of their own, and no query gets a row of its own id; equal
scores go to the smaller id; empty tables give no rows; components beyond 2^40 in
size after scaling raise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import saved
from rewardloom.session import scratch_table_path

#: Vectors of a tree, entries of a page, queries broadcast at once.
PART, PAGE, QUERY_BLOCK = 4096, 64, 4096
#: Share by which a distance's rounding may be off.
SLACK = 1e-9
_LARGEST = 1 << 40
_PAGES = "part int, page int, leaf boolean, children array<int>, pivot binary, radius double, entries binary, near array<double>, ids array<array<bigint>>"
_HITS = "query_id long, vec_id long, score long"
_RANKS = "query_id long, rank int, vec_id long, score long"


def scaled(embedding: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as a long; null if a component is null or not finite."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * F.lit(float(factor)))))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * rows.shape[1]
    if largest < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if largest < 1 << 63:
        return rows @ query
    exact = [sum(a * b for a, b in zip(r, query.tolist())) for r in rows.tolist()]
    return np.array(exact, dtype=np.int64)  # raises where a product is beyond a long


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other, greedily from the first."""
    picked = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(picked) < n:
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break
        picked.append(far)
        gap = np.minimum(gap, np.linalg.norm(points - points[far], axis=1))
    return np.array(picked)


class _Builder:
    """Bulk load of one part's distinct points."""

    def __init__(self, points: np.ndarray, vectors: np.ndarray, ids: list[list[int]]):
        self.points, self.vectors, self.ids = points, vectors, ids
        self.pages: list[dict] = []

    def build(self, rows: np.ndarray, pivot: np.ndarray) -> int:
        """Makes the page below ``pivot`` for the given rows; returns its number."""
        away = np.linalg.norm(self.points[rows] - pivot, axis=1)
        number = len(self.pages)
        page = {"page": number, "pivot": pivot.astype("<f8").tobytes(), "radius": float(away.max(initial=0.0))}
        self.pages.append(page)
        if len(rows) <= PAGE:
            order = np.argsort(away, kind="stable")
            rows, away = rows[order], away[order]
            page |= {"leaf": True, "children": [], "entries": self.vectors[rows].astype("<i8").tobytes(), "near": away.tolist(), "ids": [self.ids[r] for r in rows]}
            return number
        fan = min(PAGE, max(2, -(-2 * len(rows) // PAGE)))
        picked = _pivots(self.points[rows], fan)
        centres = self.points[rows[picked]]
        owner = np.argmin(((self.points[rows][:, None] - centres[None]) ** 2).sum(2), axis=1)
        children, near, entries = [], [], []
        for k, centre in enumerate(centres):
            if (owner == k).any():
                children.append(self.build(rows[owner == k], centre))
                near.append(float(np.linalg.norm(centre - pivot)))
                entries.append(centre)
        # A routing entry's vector is its child's pivot; near is that pivot's distance to this page's.
        page |= {"leaf": False, "children": children, "entries": np.array(entries, "<f8").tobytes(), "near": near, "ids": []}
        return number


def build_pages(vectors: np.ndarray, ids: np.ndarray, norm: float, part: int) -> list[dict]:
    """Pages of one part's tree; page 0 is the root."""
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, owner.ravel()))
    cuts = np.searchsorted(owner.ravel()[order], np.arange(len(distinct) + 1))
    own = [ids[order[a:b]].tolist() for a, b in zip(cuts, cuts[1:])]
    rest = np.sqrt(np.maximum(norm**2 - (distinct.astype(np.float64) ** 2).sum(1), 0.0))
    points = np.column_stack([distinct.astype(np.float64), rest])
    builder = _Builder(points, distinct, own)
    builder.build(np.arange(len(distinct)), points.mean(0))
    return [p | {"part": part} for p in builder.pages]


class Tree:
    """One part's pages, opened for searches."""

    def __init__(self, pages: list[dict], dim: int, norm: float):
        self.norm = norm
        self.pages = {}
        for p in pages:
            shape = (len(p["near"]), dim if p["leaf"] else dim + 1)
            entries = np.frombuffer(p["entries"], "<i8" if p["leaf"] else "<f8").reshape(shape)
            # A leaf's vectors as products() takes them, converted once.
            self.pages[p["page"]] = (p["leaf"], p["children"], entries, np.array(p["near"]), p["ids"], float(p["radius"]), np.frombuffer(p["pivot"], "<f8"))
        self.radii = {n: x[5] for n, x in self.pages.items()}

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first."""
        q = np.append(query.astype(np.float64), 0.0)
        square = float((query.astype(np.float64) ** 2).sum()) + self.norm**2
        slack = SLACK * (np.sqrt(square) + self.norm + 1.0)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst is first
        reach = np.inf  # distance of the k-th best score

        root = self.pages[0]
        gap = float(np.linalg.norm(q - root[6]))
        heap = [(max(0.0, gap - root[5]), 0, gap)]
        while heap:
            least, number, gap = heapq.heappop(heap)
            if least - slack > reach:
                break
            leaf, children, entries, near, ids, _, _ = self.pages[number]
            bound = np.abs(gap - near) - slack  # by the stored distance to the parent, without a new distance
            if leaf:
                left = np.flatnonzero(bound <= reach)
                if not len(left):
                    continue
                for e, score in zip(left.tolist(), products(entries[left], query).tolist()):
                    if len(best) == k and score < best[0][0]:
                        continue
                    for vec_id in ids[e]:
                        if vec_id == query_id:
                            continue
                        item = (score, -vec_id)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                        else:
                            break  # later ids of the entry are larger
                if len(best) == k:
                    reach = np.sqrt(max(0.0, square - 2.0 * best[0][0])) + slack
                continue
            radii = np.array([self.radii[c] for c in children])
            left = np.flatnonzero(bound - radii <= reach)
            if not len(left):
                continue
            away = np.linalg.norm(entries[left] - q, axis=1)
            for e, d in zip(left.tolist(), away.tolist()):
                low = max(0.0, d - radii[e])
                if low - slack <= reach:
                    heapq.heappush(heap, (low, children[e], d))
        return [(s, -n) for s, n in sorted(best, reverse=True)]


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    factor: int = 1024, part: int = PART, query_block: int = QUERY_BLOCK, dim: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    :param queries: condition on column ``vec_id`` that makes a row a query.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), factor).alias("v"))
    whole = saved(whole.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), "vectors")
    sizes = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim"))
    top = sizes.first() if dim is None else sizes.where(F.col("dim") == dim).first()
    if top is None or not top["dim"]:
        return spark.createDataFrame([], _RANKS)
    dim, n = top["dim"], top["n"]
    whole = whole.where(F.size("v") == dim)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    figures = whole.agg(F.max(F.sqrt(square)).alias("norm"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if figures["top"] >= _LARGEST:
        raise ValueError("a component is beyond 2^40 after scaling")
    norm = figures["norm"] * (1 + 1e-12)
    parts = max(1, -(-n // part))

    def build(rows: pa.Table) -> pa.Table:
        grid = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        made = build_pages(grid, rows.column("vec_id").to_numpy(), norm, rows.column("part")[0].as_py())
        return pa.Table.from_pylist(made, schema=_arrow_pages())

    dealt = whole.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))
    pages = saved(dealt.groupBy("part").applyInArrow(build, _PAGES), "pages")

    asked = whole.where(queries)
    n_asked = asked.count()
    blocks = max(1, -(-2 * n_asked // query_block)) if n_asked > query_block else 1  # blocks dealt by hash are uneven
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scratch_table_path(spark, "nearest")
    spark.createDataFrame([], _RANKS).write.parquet(out)
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)) == block).distinct().collect()  # one block
        if not own:
            continue
        held = spark.sparkContext.broadcast([(r["vec_id"], r["v"]) for r in own])
        hits = pages.groupBy("part").applyInArrow(_searcher(held, dim, norm, k), _HITS)
        best = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        held.unpersist()
    return spark.read.schema(_RANKS).parquet(out)


def _searcher(held, dim: int, norm: float, k: int):
    def search(rows: pa.Table) -> pa.Table:
        tree = Tree(rows.to_pylist(), dim, norm)
        found = [(i, n, s) for i, q in held.value for s, n in tree.search(i, np.array(q, np.int64), k)]
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return search


def _arrow_pages() -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("children", pa.list_(pa.int32())), ("pivot", pa.binary()),
        ("radius", pa.float64()), ("entries", pa.binary()), ("near", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64()))),
    ])
