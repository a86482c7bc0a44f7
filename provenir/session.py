"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on.

    Only settings that change results or skew handling are touched; sizing
    (shuffle partitions, memory) stays with whoever owns the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder on a cluster. Only a local
    master, as in tests, may fall back to a folder of this machine.
    """
    global _LOCAL_SCRATCH
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _LOCAL_SCRATCH is None:
            _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="provenir-")
        root = _LOCAL_SCRATCH
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For an expensive result that several branches of one plan consume: the
    work is done once, survives lost executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
