"""The folder that driver and executors share, and intermediate results in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder of spark.checkpoint.dir. A local session without one gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get()
    return f"{base.rstrip('/')}/drawkit-{uuid.uuid4().hex}"


#: Spark's setting that the shuffle files of an action go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, an action's shuffle files go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several branches use is worked out once, and lineage ends there.

    Nothing reads the write's shuffle files again, so they are freed at once.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """df as it is, but the optimizer moves no expression across: what is worked out below isn't worked out again in filters above."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
