"""Task balance with one hot example group, measured from Spark's event log.

The ``events`` table is projected to rollouts where every third user is
folded into a single example group (a third of all rows). Two plans run on
it: the preference builder, and (for comparison only) a plain window over
each whole group. For every stage that reads shuffle data the report prints
the largest and the median number of shuffle records a task read.

    python tools/skew_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rewardloom.operators.preferences import PreferenceConfig, build_preferences  # noqa: E402
from rewardloom.plans import bindings as B  # noqa: E402
from rewardloom.session import get_session  # noqa: E402


def hot_rollouts(spark, sf_dir):
    r = B.rollouts_from_events(B.table(spark, sf_dir, "events"))
    hot = (F.col("candidate_id") % 3) == 0
    return r.withColumn("id", F.when(hot, F.lit("hot")).otherwise(F.col("id"))).withColumn(
        "prompt", F.when(hot, F.lit("hot prompt")).otherwise(F.col("prompt"))
    ).withColumn("db_id", F.when(hot, F.lit("db-hot")).otherwise(F.col("db_id")))


def whole_group_window(r):
    w = Window.partitionBy("id", "db_id", "prompt").orderBy(F.col("reward").desc(), F.col("candidate_id"))
    return r.filter("valid").withColumn("rk", F.row_number().over(w)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("id", "db_id", "prompt"))
    ).filter("rk = n")


def _lines(path):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def stage_reads(log_dir):
    per_stage: dict[int, list[int]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        if path.endswith(".crc"):
            continue
        for line in _lines(path):
            ev = json.loads(line)
            if ev.get("Event") != "SparkListenerTaskEnd":
                continue
            m = ev.get("Task Metrics") or {}
            recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            if recs:
                per_stage.setdefault(ev["Stage ID"], []).append(recs)
    return per_stage


def run(label, build, sf_dir):
    log_dir = tempfile.mkdtemp(prefix=f"rl-eventlog-{label}-")
    spark = get_session(
        "local[8]", 16,
        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                    "spark.sql.adaptive.skewJoin.enabled": "false"},
    )
    build(hot_rollouts(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    total = hot_rollouts(spark, sf_dir).count()
    spark.stop()
    print(f"{label}: {total} rollout rows, hot group = {total // 3}")
    for stage, recs in sorted(stage_reads(log_dir).items()):
        print(f"  stage {stage:3d}: tasks={len(recs):3d} max={max(recs):8d} median={int(statistics.median(recs)):8d}")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    run("preference_builder_k1", lambda r: build_preferences(r, PreferenceConfig()).pairs, sf_dir)
    run("preference_builder_k3", lambda r: build_preferences(r, PreferenceConfig(max_pairs_per_example=3)).pairs, sf_dir)
    run("whole_group_window", whole_group_window, sf_dir)


if __name__ == "__main__":
    main(sys.argv)
