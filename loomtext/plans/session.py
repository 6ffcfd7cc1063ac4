"""Sessions, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Collection
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; the cluster's own settings come first."""
    root = str(Path(__file__).resolve().parents[2])
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
    b = SparkSession.builder.appName("loomtext")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local
    master, as in tests; on a cluster that is an error, since executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomtext-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "rows", **options: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, later reads take the columns that they need, and
    a lost executor costs no recomputation. The path is in the attribute ``kept_at``. ``options`` are the writer's."""
    path = shared_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    _kept.append(path)
    return out


#: Paths of kept tables that were not deleted yet.
_kept: list[str] = []


def kept() -> tuple[str, ...]:
    """The kept tables so far; ``sweep`` with an earlier answer deletes the later ones."""
    return tuple(_kept)


def sweep(spark: SparkSession, but: Collection[str]) -> None:
    """Delete all kept tables besides ``but``."""
    for path in set(_kept) - set(but):
        forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _kept:
        _kept.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, of which the default of 10,000 rows may be long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


#: Bytes of a core's share up to which a table of few files is dealt out.
SMALL = 16 << 20


def spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Fewer files than cores, with little in each, are one task each or less; their rows are dealt over
    the cores, which costs next to nothing. Any other table is read as it is."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    about = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p)
    return rows.repartition(cores) if about.getFileCount() < cores and about.getLength() < cores * SMALL else rows
