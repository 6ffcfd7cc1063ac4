"""Mixing, sampling, splitting and limits (M1-M13). Draws depend on seed and key, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.numeric import once
from loomtext.functions.text import strip_ws, uniform
from loomtext.plans.session import checkpointed


def running(df: DataFrame, value: Column, order: list[str], keys: list[str] = (), name: str = "_before") -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before each, by ``order`` and within ``keys``. Rows are dealt
    by range, so that no task sees all rows of a key; the sums of the ranges are a small table. The dealt rows are written
    once, since both sides of the join need the same ranges."""
    spread = checkpointed(df.repartitionByRange(*keys, *order).withColumns({"_p": F.spark_partition_id(), "_v": value}))
    own = spread.groupBy(*keys, "_p").agg(F.sum("_v").alias("_n"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = own.withColumn("_ahead", F.coalesce(F.sum("_n").over(past(Window.partitionBy(*keys).orderBy("_p"))), F.lit(0)))
    met = spread.join(parts.drop("_n"), [*keys, "_p"])
    inside = F.coalesce(F.sum("_v").over(past(Window.partitionBy(*keys, "_p").orderBy(*order))), F.lit(0))
    return met.withColumn(name, F.col("_ahead") + inside).select(*df.columns, name)


def source_sizes(docs: DataFrame) -> DataFrame:
    """M1, M2, exact: lines, characters and mean characters of a line with its newline, by source."""
    return docs.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.avg(F.length("text") + 1).alias("mean_chars"))


def char_weights(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """M3. Line weights (source, weight) that give the character shares ``mix`` (source, ratio): ratio / mean, over their
    sum. Sources without rows drop out; a weight of 0 becomes 0.0001. Both sides have a row per source."""
    raw = sizes.join(mix, "source").select("source", (F.col("ratio") / F.col("mean_chars")).alias("w"))
    total = raw.agg(F.sum("w").alias("total"))
    share = F.col("w") / F.col("total")
    return raw.crossJoin(total).select("source", F.when(share == 0, 0.0001).otherwise(share).alias("weight"))


def bernoulli(docs: DataFrame, mix: DataFrame, max_chars: float, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """M4. Each row of a source with probability max_chars * ratio / its characters; from 0.95 on, all rows."""
    rate = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).join(mix, "source").select("source", (max_chars * F.col("ratio") / F.col("chars")).alias("p"))
    return docs.join(rate, "source").where((F.col("p") >= 0.95) | (uniform(seed, F.col(key)) < F.col("p"))).select(*docs.columns)


def interleave(docs: DataFrame, mix: DataFrame, buffer: int = 50_000, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """M5. ``docs`` with ``round``, ``source_no`` and ``draw``; sorting by these reads the sources in turns, in bursts in
    proportion to their ratios, shuffled inside a burst. All rows stay."""
    top = mix.agg(F.max("ratio").alias("top"))
    order = mix.crossJoin(top).select("source", F.greatest(F.lit(1), F.floor(buffer * F.col("ratio") / F.col("top"))).alias("burst"), F.row_number().over(Window.orderBy("source")).alias("source_no"))
    numbered = running(docs, F.lit(1), [key], ["source"], "_rn")
    return numbered.join(order, "source").select(*docs.columns, F.floor(F.col("_rn") / F.col("burst")).alias("round"), "source_no", uniform(seed, F.col(key)).alias("draw"))


def split_of(key: Column, train: float = 0.9, valid: float = 0.05, seed: int = 42) -> Column:
    """M6. train, valid or test."""
    u = uniform(seed, key)
    return F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")


def assign_splits(docs: DataFrame, ratios: list[float] | None = None, sources: list[str] | None = None, key: str = "doc_id", **shares) -> DataFrame:
    """M7. ``docs`` with ``split``, texts without their outer white space, blank ones left out."""
    if ratios is not None and len(ratios) != len(sources or ()):
        raise ValueError(f"{len(ratios)} ratios for {len(sources or ())} sources")
    return docs.withColumn("text", once(strip_ws(F.col("text")))).where("text <> ''").withColumn("split", split_of(F.col(key), **shares))


def split_stats(split: DataFrame) -> DataFrame:
    """M7. Rows and characters by split and source."""
    return split.groupBy("split", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def sample_k(docs: DataFrame, n: int, min_len: int = 20, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """M8, M10. A uniform sample of n rows with min_len characters: the smallest draws."""
    return docs.where(F.length("text") >= min_len).orderBy(uniform(seed, F.col(key)), key).limit(n)


def of_subjects(items: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """M12. Items of the named subjects; all without names. An item without a subject has the empty one."""
    return items.where(F.coalesce("subject", F.lit("")).isin(subjects)) if subjects else items


def head(docs: DataFrame, n: int, order: str) -> DataFrame:
    """M9."""
    return docs.orderBy(order).limit(n)


def category_build(parts: dict[str, DataFrame], shares: dict[str, float], total: int, seed: int = 42, key: str = "key") -> DataFrame:
    """M11. Rows of each category, repeated up to its share of ``total`` and cut there by draw."""
    out = None
    for name, df in parts.items():
        want = int(total * shares[name])
        have = max(1, df.count())
        tiled = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(-(-want // have)))))
        own = tiled.orderBy("_copy", uniform(seed, F.col(key)), key).limit(want).drop("_copy").withColumn("category", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def max_chars(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """M13. The first n characters of the texts in order; the last text may be cut."""
    at = running(docs, F.length("text"), [order], name="_at").where(F.col("_at") < n)
    return at.withColumn("text", F.substring("text", F.lit(1), F.least(F.length("text"), F.lit(n) - F.col("_at")).cast("int"))).select(*docs.columns)
