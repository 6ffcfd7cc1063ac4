"""What the operators share: scratch tables in the cluster's shared folder, Arrow batching, word splitting, components."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.session import checkpointed, forget, shared_path

#: Rows in an Arrow batch. A document may hold 100 KB and more, so the default of 10,000 rows could fill a worker.
BATCH_ROWS = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return shared_path(spark, name)


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no
    recomputation. The path is in the attribute ``kept_at``."""
    return checkpointed(df, name, **options)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more, and let Spark delete the shuffle files of finished steps: it does so
    when the driver's memory is collected, which may else be half an hour later."""
    for t in tables:
        forget(spark, t.kept_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes (the operators regroup them), and let workers on this machine import the
    package from where the driver has it."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers idle between tasks, and stages that run in
    the JVM need it then."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def tables(batches: Iterable[pa.RecordBatch], column: str | None = "text", limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Regroup batches into tables whose ``column`` holds about ``limit`` bytes; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        n = (b.column(b.schema.get_field_index(column)) if column else b).nbytes
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    trim()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() if not isinstance(c, pa.Array) and c.num_chunks else pa.array([], c.type) if c.num_chunks == 0 else c


#: Bytes that are no part of an alphanumeric word: all ASCII but 0-9, A-Z and a-z.
_ALNUM = np.arange(256, dtype=np.uint8)
_ALNUM[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def split_words(texts: pa.Array, lower: bool = False, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: codes into the dictionary, words per text, and the dictionary (binary).

    A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), or with ``alnum`` a run of ASCII
    letters, digits and non-ASCII. ``lower`` maps A-Z to a-z. Null has no words.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    if lower:
        texts = pc.ascii_lower(texts)
    if alnum:
        _, offsets, data = texts.buffers()
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        texts = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(_ALNUM[raw]), offset=texts.offset)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = coded.dictionary.cast(pa.binary())
    empty = pc.index(words, b"").as_py()
    full = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return codes[full], np.diff(before[edges]), words


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    from xxhash import xxh3_64_intdigest as h

    return np.fromiter((h(w) for w in words.to_pylist()), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (counts[i] of them), one after another."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of (a, b) links by alternating large-star and small-star rounds: (node, root), root the
    smallest node reachable. Every round writes its links to the shared folder; nothing is collected but a count."""
    spark = edges.sparkSession
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = state(links)
    while True:
        # large star: all larger neighbours of a node move to its smallest neighbour
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: all smaller neighbours of a node, and itself, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = keep(small, "links")
        forget(spark, links.kept_at)
        links, before = new, seen
        seen = state(links)
        if seen == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
