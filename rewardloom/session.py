"""Session helpers.

The cluster names its shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only set one of our own when it is unset (local
tests).
"""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ranking checkpoints live in the shared folder; delete them once unused.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "rewardloom",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Returns the active session or builds one with sane defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _own_folder(prefix: str) -> str:
    """A new folder on this machine, gone when this process ends."""
    made = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def checkpoint_dir(spark: SparkSession) -> str:
    """Returns the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    # Unset: only a local master may use a folder of this machine.
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(
            f"spark.checkpoint.dir is not set; executors of {sc.master} need a shared folder for intermediate tables"
        )
    local = _own_folder("rewardloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(_own_folder("rewardloom-code-")) / "rewardloom_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(str(path))  # the driver serves it; executors fetch their own copy
    _SHIPPED.add(sc.applicationId)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared checkpoint folder and reads it back; cuts its lineage."""
    path = scratch_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
