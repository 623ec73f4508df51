"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has 64 bits, one a majority vote of its word shingles'
hashes. Two fingerprints link when they differ in at most ``max_bits`` bits.

The trie is laid out over the cluster by its first block of bits: cut into
``max_bits + 1`` blocks, two linked fingerprints agree in a whole block, so one
trie is kept for each rotation that brings a block to the top, and node pairs
below different top blocks are already over their budget of zero there. Each
task holds the sub-tries below some top blocks as sorted arrays, in which a node
is a range, and walks all its node pairs level by level: the two nodes' children
are paired, a differing bit takes one from the pair's budget, and a pair with
none left goes. Pairs of small nodes compare their leaves.

A top block with more than ``chunk`` fingerprints is dealt into chunks, and each
pair of chunks is a task of its own, so no task holds more than two chunks. From
its links a task returns a star per group of linked fingerprints, never the
links themselves; stars are joined by connected components.

Cases: a null text counts as empty, an empty text has fingerprint zero and links
like any other; repeated rows have equal fingerprints and give one trie leaf; a
null ``doc_id`` is fingerprinted and linked but never a component's id, which is
null where no linked row has an id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import saved

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Largest part of a top block that one task holds.
CHUNK = 2000
#: Node pairs of at most so many leaf pairs compare their leaves at once.
PAGE = 64
#: Node or leaf pairs handled at once.
FRONTIER = 2_000_000

_LANES = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())],
        dtype="<u8",
    )
    # One count per byte lane and byte value; each lane's bits come from its counts.
    by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of each of n blocks."""
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _expand(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every range pair, all (pair, place in a, place in b)."""
    sizes = n_a * n_b
    pair = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pair, within // n_b[pair], within % n_b[pair]


def _linked(values: np.ndarray, pairs: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked leaves below the given node pairs.

    :param values: fingerprints; each node is a sorted range of them.
    :param pairs: rows (a_lo, a_hi, b_lo, b_hi) of nodes that agree down to ``depth``.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    ones: dict[int, np.ndarray] = {}
    stack = []
    for d in np.unique(depth):
        rows = pairs[depth == d]
        stack.append((int(d), rows, np.full(len(rows), budget, np.int64)))
    while stack:
        d, node, spare = stack.pop()
        if len(node) > FRONTIER:
            half = len(node) // 2
            stack += [(d, node[:half], spare[:half]), (d, node[half:], spare[half:])]
            continue
        a_lo, a_hi, b_lo, b_hi = node.T
        small = ((a_hi - a_lo) * (b_hi - b_lo) <= PAGE) | (d == 64)
        if small.any():
            s = node[small]
            for part in np.array_split(s, max(1, len(s) * PAGE // FRONTIER)):
                pair, i, j = _expand(part[:, 1] - part[:, 0], part[:, 3] - part[:, 2])
                i, j = part[pair, 0] + i, part[pair, 2] + j
                near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
                left.append(i[near])
                right.append(j[near])
        node, spare = node[~small], spare[~small]
        if not len(node):
            continue
        if d not in ones:
            bit = ((values >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)
            ones[d] = np.concatenate(([0], np.cumsum(bit)))
        a_lo, a_hi, b_lo, b_hi = node.T
        a_mid = a_hi - (ones[d][a_hi] - ones[d][a_lo])
        b_mid = b_hi - (ones[d][b_hi] - ones[d][b_lo])
        same = a_lo == b_lo  # a node paired with itself: the two crossed pairs are one
        children = np.concatenate([
            np.stack([a_lo, a_mid, b_lo, b_mid], 1),
            np.stack([a_mid, a_hi, b_mid, b_hi], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi], 1),
            np.stack([a_mid, a_hi, b_lo, b_mid], 1)[~same],
        ])
        spare = np.concatenate([spare, spare, spare - 1, spare[~same] - 1])
        alive = (spare >= 0) & (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
        stack.append((d + 1, children[alive], spare[alive]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest position of its linked group."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _join_groups(frame: pd.DataFrame, max_bits: int, skip: np.ndarray) -> pd.DataFrame:
    """Stars within each group of rows sorted by (rotation, top, a, b, side, turned)."""
    values = frame["turned"].to_numpy().view(np.uint64)
    keys = frame[["rotation", "top", "a", "b", "side"]].to_numpy()
    new_side = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
    new_group = np.concatenate(([True], (keys[1:, :4] != keys[:-1, :4]).any(1)))
    side_at = np.append(np.flatnonzero(new_side), len(values))
    pairs, depth = [], []
    for k, start in enumerate(side_at[:-1]):
        end = side_at[k + 1]
        rotation, _, a, b, side = keys[start]
        if a == b:
            pairs.append((start, end, start, end))
        elif side == 0 and k + 2 < len(side_at) and not new_group[end]:
            pairs.append((start, end, end, side_at[k + 2]))
        else:
            continue
        depth.append(skip[rotation])
    if not pairs:
        return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
    i, j = _linked(values, np.array(pairs, np.int64), np.array(depth), max_bits)
    label = _stars(len(values), i, j)
    own = np.flatnonzero(label != np.arange(len(values)))
    fp = frame["fp"].to_numpy()
    return pd.DataFrame({"src": fp[own], "dst": fp[label[own]]})


def links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (src, dst) that connect what the linked pairs of ``fps.fp`` connect.

    :param fps: distinct, non-null fingerprints.
    """
    blocks = _blocks(max_bits + 1)
    turned = [
        F.struct(
            F.lit(k).alias("rotation"),
            (F.col("fp") if not a else F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", 64 - a))).alias("turned"),
            F.lit(64 - bits).alias("rest"),
        )
        for k, (a, bits) in enumerate(blocks)
    ]
    rows = (
        fps.select("fp", F.explode(F.array(*turned)).alias("t"))
        .select("fp", "t.rotation", "t.turned", F.expr("shiftrightunsigned(t.turned, t.rest)").alias("top"))
    )
    sizes = rows.groupBy("rotation", "top").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["rotation", "top"])
    n_chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_chunks.cast("long")).cast("int")
    sent = sized.select(
        "fp", "rotation", "top", "turned", own.alias("own"),
        F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("other"),
    ).select(
        "rotation", "top",
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "turned", "fp",
    )
    order = ["rotation", "top", "a", "b"]
    sent = sent.repartition(*order).sortWithinPartitions(*order, "side", "turned")
    skip = np.array([bits for _, bits in blocks])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of a group that may go on in the next batch
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            key = batch[order].to_numpy()
            cut = int(np.argmax((key == key[-1]).all(1)))
            rest = batch.iloc[cut:].reset_index(drop=True)
            if cut:
                yield _join_groups(batch.iloc[:cut], max_bits, skip)
        if rest is not None and len(rest):
            yield _join_groups(rest, max_bits, skip)

    return sent.mapInPandas(join, "src long, dst long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``, root the smallest node it reaches.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until the edges no longer change. Each round is written to the shared
    scratch folder.
    """
    edges = saved(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select("u", F.col("m").alias("v")).unionAll(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = saved(small.distinct(), "edges")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(before) == tuple(state):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS, chunk: int = CHUNK,
) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fp, root, component_id).

    ``root`` is the group's smallest fingerprint, so that rows belong together
    exactly if their roots are equal; ``component_id`` is the group's smallest id.
    """
    prints = saved(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")), "fingerprints")
    return components(prints, max_bits, chunk)


def components(prints: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``near_duplicates`` of a written table with columns doc_id and fp."""
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    parts = connected_components(links(fps.select("fp"), max_bits, chunk))
    rooted = fps.join(parts, fps["fp"] == parts["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root")
    return prints.join(by_fp, "fp").select(*[c for c in prints.columns if c != "fp"], "fp", "root", "component_id")
