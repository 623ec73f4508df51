from __future__ import annotations

import random

import pytest
import xxhash

from rewardloom.llm import queries as Q
from rewardloom.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple[int | None, int]], max_bits: int) -> dict[int, int | None]:
    """Smallest id reachable from each fingerprint."""
    fps = sorted({f for _, f in rows})
    group = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= max_bits and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    return {f: min((i for i, g in rows if g in group[f] and i is not None), default=None) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \n", "One two", "A b\tC\nd e F g", "Äpfel und ÖL und noch mehr Äpfel und ÖL"])
def test_fingerprint_equals_a_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("chunk", [3, 2000])
def test_components_equal_brute_force(spark, chunk):
    """Clusters of near fingerprints, also where a top block is dealt into chunks."""
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            f = centre
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            rows.append((rng.randrange(10_000), f))
    rows += [(None, rows[0][1]), (None, 12345), (3, 0), (3, 0)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    prints = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(prints, chunk=chunk).collect()}
    want = plain_components(rows, 4)
    assert got == {(i, f, want[f]) for i, f in rows}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(7, 7)], "src long, dst long")
    assert {(r["node"], r["root"]) for r in simhash.connected_components(edges).collect()} == {(k, 0) for k in range(1, 201)}


def test_awkward_rows(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    fox = simhash.fingerprint("the quick brown fox jumps over")
    assert {f % (1 << 64) for f, _ in by[5]} == {fox} and {c for f, c in by[None] if f % (1 << 64) == fox} == {5}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    want = plain_components(rows, 4)
    got = {tuple(r) for r in Q.op9_simhash_near_dedup(spark, SF).collect()}
    assert got == {(i, f"{f:016x}", want[f]) for i, f in rows}
