"""Cleaning and exact dedup as a stream. The state is a digest per distinct text; give a watermark to bound it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.clean import clean


def clean_dedup(stream: DataFrame, event_time: str | None = None, delay: str = "1 hour", **options) -> DataFrame:
    """Kept texts of a stream, each once. With an event time, a copy that comes later than ``delay`` counts as new."""
    kept = clean(stream, **options).where("reason is null").withColumn("digest", F.md5("clean"))
    if event_time:
        return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])
    return kept.dropDuplicates(["digest"])


def stream_clean_dedup(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path`` through the stream, to a table in the shared folder, until none is left."""
    from loomtext.plans.session import shared_path

    out = shared_path(spark, "stream")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        reader, path = reader.option("pathGlobFilter", p.getName()), str(p.getParent())  # a stream's source is a folder
    source = reader.parquet(path)
    kept = clean_dedup(source).select("doc_id", "clean")
    query = kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/rows")
