"""Sinks (K1-K9). Spark's committers make partial and backup files unnecessary: an output is whole or absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import wrap


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    """K1. A text line per row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """K2. The wrapped texts, a line each, in a folder for each split; what an earlier run left goes with the overwrite."""
    df.select("split", wrap(F.col("text")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """K3. JSON lines, characters as they are."""
    df.write.mode("overwrite").json(path)


def write_fingerprints(df: DataFrame, path: str) -> None:
    """K5. Distinct (source, fp)."""
    df.select("source", "fp").distinct().write.mode("overwrite").parquet(path)


def write_tokens(df: DataFrame, path: str, tokenizer_digest: str, max_chars: int | None = None) -> str:
    """K6. Token arrays in a folder that names the tokenizer and the limit, so that a stale cache is never read."""
    out = f"{path}/tokens-{tokenizer_digest}-{max_chars or 'all'}"
    if not done(df.sparkSession, out):
        df.write.mode("overwrite").parquet(out)
    return out


def write_report(spark: SparkSession, report: dict, path: str, meta: dict) -> None:
    """K8. An evaluation report with its ``_meta`` as one JSON document."""
    spark.createDataFrame([(json.dumps(report | {"_meta": meta}, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def done(spark: SparkSession, path: str) -> bool:
    """K9. Whether a stage's output was committed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
