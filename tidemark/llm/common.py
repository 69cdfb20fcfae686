"""What several of the operators need: shared storage and row streams."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python operator hands back at once.
OUT_ROWS = 2000
#: Bytes of an Arrow batch (a larger row is a batch of its own).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder is
    made and set if both are one process (tests), and it is an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back: it cuts the lineage, and
    a lost executor costs a reread and not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which can go when the application has ended."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, so that long texts take bounded memory in the
    JVM and in Python. Spark has no such setting for one operator: it is made in df's session, where
    a lower one stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(conf.get(key)), re.I)
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def tidied(run):
    """run that gives free memory back to the system at a task's end: workers serve task after task, and
    what they once held would stay theirs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def slices(batch: pa.RecordBatch, rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some rows, so that the Python copies of long texts stay few."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def field_names(df: DataFrame, *names: str) -> None:
    """ValueError if a wanted column is missing or there twice (Spark compares without case)."""
    have = [c.lower() for c in df.columns]
    for name in names:
        if have.count(name.lower()) != 1:
            raise ValueError(f"needs exactly one column {name!r}; there are {df.columns}")


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Only the wanted columns: others, whatever their names, can't clash with an operator's own."""
    field_names(df, *names)
    return df.select(*names)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    have = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(have) + 1)) if n.lower() not in have) for name in names]
