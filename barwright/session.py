"""Session settings and the shared folder used for checkpoints and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Feature plans compile a few hundred small classes; the default cache of 100 would evict them.
    "spark.sql.codegen.cache.maxEntries": "4000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # HotSpot does not compile methods above 8000 bytes; wide projections run faster split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "barwright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: epoch arithmetic needs a UTC session."""
    for name in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        if spark.conf.get(name) != SETTINGS[name]:
            spark.conf.set(name, SETTINGS[name])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    A folder of this machine is only made for a single-process session; elsewhere executors and
    driver would each write to their own disk, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="barwright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root for a staged table."""
    return f"{checkpoint_root(spark).rstrip('/')}/barwright/{name}-{uuid.uuid4().hex}"
