from __future__ import annotations

import random

import numpy as np
import pytest

from rewardloom.llm import decontaminate as D

WORDS = [a + b for a in "bdfgklmnprst" for b in ("ala", "eno", "iru", "otu", "una", "as")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(WORDS)
        elif kind == 1:
            words.insert(at, rng.choice(WORDS))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [(k, rng.choices(WORDS, k=rng.randrange(12, 50))) for k in range(30)]
    docs, edits = [], {}
    for k in range(120):
        body = rng.choices(WORDS, k=80)
        if k % 2 == 0:
            n, words = items[k % 30]
            e = (0, len(words) // 20, len(words) // 10)[k % 3]
            near = edited(rng, words, e)
            body = body[:40] + near + body[40:]
            edits[k, n] = e
        docs.append((k, " ".join(body)))
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    return items, spark.createDataFrame(docs, "doc_id long, text string"), table, docs, edits


def test_finds_planted_items_and_nothing_else(planted):
    items, docs, table, texts, edits = planted
    rows = D.leaks(docs, table).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    exact = {k for k, e in edits.items() if e == 0}
    assert exact <= found
    assert len(found & set(edits)) >= 0.97 * len(edits)
    by_id, whole = dict(items), dict(texts)
    for r in rows:
        window = whole[r["doc_id"]].split()[r["first_word"] : r["first_word"] + r["n_words"]]
        item = by_id[r["item_id"]]
        assert distance(item, window) == r["edits"] <= 0.2 * len(item)


def test_blocks_of_items_give_the_same(planted):
    _, docs, table, _, _ = planted
    one = {tuple(r) for r in D.leaks(docs, table).collect() if r["edits"] == 0}
    many = {tuple(r) for r in D.leaks(docs, table, block_words=300).collect() if r["edits"] == 0}
    assert one == many


def test_best_window_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        item, words = rng.choices(range(4), k=rng.randrange(1, 9)), rng.choices(range(4), k=rng.randrange(12))
        want = min(distance(item, words[:n]) for n in range(len(words) + 1))
        got = D.best_window(np.array(item), np.array(words, dtype=int), 3)
        assert (got is None) == (want > 3)
        if got:
            assert got[0] == want == distance(item, words[: got[1]])


def test_case_marks_and_awkward_rows(spark, awkward):
    words = " ".join(WORDS[:20])
    marked = " | ".join(w.upper() + "!!" for w in WORDS[:20])
    docs = awkward.select("doc_id", "text").unionAll(spark.createDataFrame([(50, "x " + marked + " y"), (None, words), (51, words), (51, words)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, words), (2, words), (3, None), (4, ""), (5, "bala beno")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.leaks(docs, items).collect()), key=str)
    want = [(i, n, 0) for i in (50, None, 51, 51) for n in (1, 2)]
    short = [(i, 5, 0) for i in (50, None, 51, 51) if " ".join(WORDS[:2]) == "bala beno"]
    assert got == sorted(want + short, key=str)
    assert D.leaks(docs.limit(0), items).collect() == [] and D.leaks(docs, items.limit(0)).collect() == []


def test_start_after_an_earlier_candidate_is_compared():
    """The first word is replaced, the edits are at the limit, and a candidate lies just before."""
    rng = random.Random(5)
    item = rng.sample(WORDS, 20)
    near = list(item)
    for at in (0, 6, 11, 17):
        near[at] = "unknown"
    index = D.Index([(7, item)], D.MAX_SHARE, D.REPETITIONS, D.SAMPLES)
    text = rng.choices(WORDS, k=15) + near + rng.choices(WORDS, k=15)
    codes = np.array([index.vocabulary.get(w, 1) for w in text] + [0])
    for earlier in (1, 2, 3):
        index.candidates = lambda codes, e=earlier: {(15 - e, 0), (15, 0)}
        assert list(index.leaks(codes, np.array([0, len(codes)]))) == [(0, 0, 15, 20, 4)]


def test_best_start_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item, words = rng.choices(range(4), k=rng.randrange(1, 9)), rng.choices(range(4), k=rng.randrange(1, 12))
        starts = rng.randrange(1, len(words) + 1)
        every = [(min(distance(item, words[s:e]) for e in range(s, len(words) + 1)), s) for s in range(starts)]
        want = min(every)
        assert D.best_start(np.array(item), np.array(words), starts, 3) == (want if want[0] <= 3 else None)


def test_exact_copies_of_items_of_any_size():
    rng = random.Random(11)
    for sizes in [(n,) for n in range(1, 16)] + [tuple(range(1, 16))]:
        items = [(k, rng.choices(WORDS, k=sizes[k % len(sizes)])) for k in range(90)]
        index = D.Index(items, D.MAX_SHARE, D.REPETITIONS, D.SAMPLES)
        texts = [rng.choices(WORDS, k=9) + words + rng.choices(WORDS, k=9) for _, words in items]
        codes = [[index.vocabulary.get(w, 1) for w in t] + [0] for t in texts]
        begin = np.cumsum([0] + [len(c) for c in codes])
        found = {(r[0], r[1]): r for r in index.leaks(np.concatenate(codes), begin)}
        for k, (text, (_, words)) in enumerate(zip(texts, items)):
            first = next(s for s in range(10) if text[s : s + len(words)] == words)
            assert found[k, k] == (k, k, first, len(words), 0)


@pytest.mark.parametrize("size", [5, 6, 7, 8, 10, 20, 60])
def test_recall_at_the_largest_share_of_edits(size):
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, rng.choices(vocabulary, k=size)) for k in range(200)]
    index = D.Index(items, D.MAX_SHARE, D.REPETITIONS, D.SAMPLES)
    found = 0
    for k, words in items:
        near = list(words)
        for at in rng.sample(range(size), int(D.MAX_SHARE * size)):
            near[at] = "unknown"
        text = rng.choices(vocabulary, k=20) + near + rng.choices(vocabulary, k=20)
        codes = np.array([index.vocabulary.get(w, 1) for w in text] + [0])
        found += any(r[1] == k for r in index.leaks(codes, np.array([0, len(codes)])))
    assert found >= 0.98 * len(items)


def test_places_left_out_hold_no_leak():
    """Candidates at all places, checked exactly, against those at the places kept."""
    rng = random.Random(21)
    items = [(k, rng.choices(WORDS[:40], k=rng.randrange(5, 40))) for k in range(60)]
    index = D.Index(items, D.MAX_SHARE, D.REPETITIONS, D.SAMPLES)
    texts = [rng.choices(WORDS, k=30) + edited(rng, words, rng.randrange(0, 1 + len(words) // 5)) + rng.choices(WORDS, k=30) for _, words in items]
    codes = [[index.vocabulary.get(w, 1) for w in t] + [0] for t in texts]
    begin, codes = np.cumsum([0] + [len(c) for c in codes]), np.concatenate(codes)
    kept = list(index.leaks(codes, begin))
    index.able = lambda c: [np.ones(len(c), bool) for _ in index.reach]
    assert kept == list(index.leaks(codes, begin)) and len(kept) >= 55


def test_every_near_window_passes_the_count_of_pairs():
    rng = random.Random(4)
    for _ in range(300):
        item = rng.choices(WORDS[:30], k=rng.randrange(5, 30))
        index = D.Index([(0, item)], D.MAX_SHARE, 1, D.SAMPLES)
        near = edited(rng, item, int(D.MAX_SHARE * len(item)))
        before = rng.choices(WORDS, k=rng.randrange(12))
        codes = np.array([index.vocabulary.get(w, 1) for w in before + near + rng.choices(WORDS, k=5)] + [0])
        assert index.able(codes)[0][len(before)]
