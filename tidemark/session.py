"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SCRATCH_KEY = "tidemark.scratch.dir"

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # Plans are built from thousands of small expressions; do not record a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Shuffle parallelism is left to the cluster (AQE coalesces from whatever
    ``spark.sql.shuffle.partitions`` says); pass it in ``conf`` for local runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_local_scratch(spark: SparkSession) -> None:
    """Name a temporary folder for intermediate tables where the session names none.

    For tests and single-machine runs: their entry points call this, operators
    never do. A cluster has to name a folder that all its machines share.
    """
    if spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get(SCRATCH_KEY, None):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    spark.conf.set(SCRATCH_KEY, tempfile.mkdtemp(prefix="tidemark-"))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` (or else ``tidemark.scratch.dir``) names."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get(SCRATCH_KEY, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once, to the shared folder unless ``path`` is given, and read it back.

    For a result that several later jobs start from (for example suggestions
    that are reviewed, previewed and then applied): it cuts the lineage and,
    unlike a cache, survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
