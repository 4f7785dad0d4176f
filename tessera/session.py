"""Session settings the jobs rely on, and reliable checkpoints."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of what one Python step gets at once, so long texts do not make a batch of rows large
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job assumes; cluster sizing is left to the cluster."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only where neither names one and the session is local (tests, laptops) a temporary folder is made; on a cluster that is
    an error, because a machine-local folder is not shared and would not survive a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and return the written rows.

    Iterative jobs call this once per round: plans stay short, a lost executor only costs its running
    tasks, and the next round knows the true size of its inputs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._written_to = path
    return rows


def discard(*frames: DataFrame) -> None:
    """Delete the folders behind results of :func:`cut_lineage` that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = df.__dict__.pop("_written_to", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
