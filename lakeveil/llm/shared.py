"""What the operators of this package share: tables in the shared folder, Arrow helpers, worker memory."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions travel to the workers by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["lakeveil"])

#: Rows that a worker turns into Python objects at a time.
SLICE = 256
#: Entries of a worker's word memo; it is emptied at this size.
MEMO = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, an own one on one machine, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(spark, "_lakeveil_dir", None) or tempfile.mkdtemp(prefix="lakeveil-")
        spark._lakeveil_dir = path
    return path.rstrip("/")


def clean_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done, which it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder (with the writer's options) and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeveil-{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**(options or {})).parquet(path)
    clean_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeveil_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lakeveil_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def per_slice(rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], size: int = SLICE) -> Callable:
    """A function for mapInArrow that works on slices of the batches, so memory doesn't follow the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = rows(batch.slice(at, size))
                if out is not None and out.num_rows:
                    yield out

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; a null text counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def worker_memory() -> dict:
    """A dictionary that lives as long as the Python worker, over tasks."""
    if not hasattr(sys, "_lakeveil_worker"):
        sys._lakeveil_worker = {}
    return sys._lakeveil_worker


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
