"""The per-row rules over a file stream (availableNow trigger)."""

from __future__ import annotations

import json
import os
import tempfile

from rewardloom.streaming import generations as G


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="rl-stream-")
    src, sink, ckpt = (os.path.join(d, x) for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    rows = [
        {"gen_id": "a", "db_id": "db", "text": "```sql\nSELECT a FROM t JOIN u ON t.x = u.x\n```"},
        {"gen_id": "b", "db_id": "db", "text": "DROP TABLE t"},
        {"gen_id": "c", "db_id": "db", "text": "<|im_start|>assistant\nSELECT * FROM t; <|im_end|>"},
    ]
    with open(os.path.join(src, "part-0.jsonl"), "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    q = G.start(spark, src, sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    got = {r.gen_id: (r.sql, r.valid, r.difficulty) for r in spark.read.parquet(sink).collect()}
    batch = G.checked_generations(spark.read.schema(G.GENERATION_SCHEMA).json(src))
    want = {r.gen_id: (r.sql, r.valid, r.difficulty) for r in batch.collect()}
    assert got == want
    assert got["a"] == ("SELECT a FROM t JOIN u ON t.x = u.x", True, "medium")
    assert got["b"] == ("", False, "easy")
