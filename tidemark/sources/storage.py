"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder is made and set if driver and executors are one
    process (tests), and it is an error on a cluster, whose machines share no temporary folder."""
    context = spark.sparkContext
    if conf := context.getConf().get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table in the folder that the cluster shares: it cuts the lineage, takes no executor's
    memory, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
