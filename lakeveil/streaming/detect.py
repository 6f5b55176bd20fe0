"""Detection over streams of pages, and a registry that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_name, folded
from ..operators import detect, registry


def read_pages(spark: SparkSession, path: str, schema: str = "container string, page_no bigint, text string", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def detections(pages: DataFrame) -> DataFrame:
    """All detectors but the lexicon; a stateless map, so it is the same for streams and tables."""
    return detect.detect(pages)


def grow(spark: SparkSession, path: str):
    """A function for foreachBatch: new values of a batch get the next numbers of their container and type.

    Batches are written to folders named by their number; a batch that is done again writes the same folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        done = sorted(f"{path}/batch={n}" for n in range(number) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}")))
        new = registry.assign(batch)
        if done:
            known = spark.read.parquet(*done)
            last = known.groupBy("container", "entity_type").agg(F.max(F.regexp_extract("placeholder", r"_(\d+)$", 1).cast("int")).alias("last"))
            fresh = batch.withColumns({"entity_type": entity_name(F.col("entity_type")), "key": folded(F.col("value"))}).join(known.select("container", "entity_type", "key"), ["container", "entity_type", "key"], "left_anti").drop("key")
            new = registry.assign(fresh).join(last, ["container", "entity_type"], "left")
            k = F.regexp_extract("placeholder", r"_(\d+)$", 1).cast("int") + F.coalesce("last", F.lit(0))
            new = new.withColumn("placeholder", registry.placeholder(F.col("entity_type"), k)).drop("last")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
