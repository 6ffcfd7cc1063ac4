"""End-to-end plans with the options of the command line they replace: extract, pipeline, build."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import conversion_table
from loomtext.operators import clean, dedup, mix, qa
from loomtext.plans.config import Settings, load
from loomtext.plans.session import kept, sweep
from loomtext.sources import readers, writers

# Sources of a mix, in its order; the options below keep the names and defaults that users know.
SOURCES = ("edu", "news", "wiki", "baike", "qa")
# Character shares of the sources by variant.
MIXES = {"nano": (0.55, 0.05, 0.15, 0.10, 0.15), "lite": (0.35, 0.20, 0.20, 0.15, 0.10), "pro": (0.35, 0.20, 0.20, 0.15, 0.10)}


def prepare(docs: DataFrame, min_len: int = 10, max_len: int = 2000) -> DataFrame:
    """Exact dedup, cleaning, split."""
    kept = clean.clean(dedup.dedup_exact(docs), min_len=min_len, max_len=max_len).where("reason is null")
    return mix.assign_splits(kept.withColumn("text", F.col("clean")).drop("clean", "reason"))


def pipeline(docs: DataFrame, skip_exact_dedup: bool = False, skip_clean: bool = False, skip_simhash: bool = False, cross_dedup: bool = False, exact_mode: str = "exact", prefix_len: int = 100, simhash_threshold: int = 3, sources: list[str] | None = None, order: str = "doc_id", table: tuple[str, str] = ("", "")) -> DataFrame:
    """Raw rows (order, source, text) to deduplicated ones: exact or prefix dedup by source (news always by prefix),
    cleaning (news with the advertisement filter, wiki with its own), near-dedup by source, QA rows by the QA filter,
    and on request near-dedup across sources. ``table`` converts characters in all sources but edu."""
    wanted = sources or [r["source"] for r in docs.select("source").distinct().collect()]  # a handful of names
    known = {r["source"] for r in docs.select("source").distinct().collect()}
    if missing := set(wanted) - known:
        raise ValueError(f"unknown sources: {', '.join(sorted(missing))}")
    out = None
    for source in wanted:
        rows = docs.where(F.col("source") == source)
        if not skip_exact_dedup:
            by_prefix = source == "news" or exact_mode == "prefix"
            rows = dedup.dedup_prefix(rows, prefix_len, order) if by_prefix else dedup.dedup_exact(rows, order)
        if not skip_clean:
            judged = clean.clean(rows, min_len=30, max_len=3000, zh=0.15, ads=source == "news", wiki=source == "wiki", table=("", "") if source == "edu" else table)
            rows = judged.where("reason is null").withColumn("text", F.col("clean")).drop("clean", "reason")
        if source == "qa":
            rows = qa.filter_qa(rows, order)
        elif not skip_simhash:
            rows = dedup.dedup_simhash(rows, simhash_threshold, order)
        out = rows if out is None else out.unionByName(rows)
    return dedup.dedup_cross(out, simhash_threshold).drop("fp") if cross_dedup else out


def build(docs: DataFrame, variant: str = "nano", max_chars: float | None = None, key: str = "doc_id") -> DataFrame:
    """Deduplicated rows to splits: sampled to the variant's character shares if max_chars is given."""
    shares = docs.sparkSession.createDataFrame(list(zip(SOURCES, MIXES[variant], strict=True)), "source string, ratio double")
    rows = mix.bernoulli(docs, shares, max_chars, key=key) if max_chars else docs
    return mix.assign_splits(rows, key=key)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomtext")
    p.add_argument("job", choices=["extract", "pipeline", "build"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=sorted(readers.EXTRACTORS))
    p.add_argument("--config", help="settings file; options given here go over it")
    p.add_argument("--variant", choices=sorted(MIXES))
    p.add_argument("--max_chars", type=float)
    p.add_argument("--exact_mode", choices=["exact", "prefix"])
    p.add_argument("--prefix_len", type=int)
    p.add_argument("--simhash_threshold", type=int)
    p.add_argument("--zh_table", help="text file of characters and their simplified forms")
    p.add_argument("--sources", nargs="*")
    for flag in ("skip_exact_dedup", "skip_clean", "skip_simhash", "cross_dedup"):
        p.add_argument(f"--{flag}", action="store_true", default=None)
    a = p.parse_args(args)
    settings = load(a.config) if a.config else Settings()
    c = replace(settings, **{f.name: v for f in fields(Settings) if (v := getattr(a, f.name)) is not None})
    spark, before = SparkSession.builder.getOrCreate(), kept()
    if a.job == "extract":
        if a.format == "edu":
            rows = spark.read.parquet(a.input).select("text")
        else:
            rows = readers.json_lines(readers.archive_lines(spark, a.input), readers.RECORDS[a.format]).where("valid")
        writers.write_lines(readers.EXTRACTORS[a.format](rows), a.output)
    elif a.job == "pipeline":
        rows = pipeline(spark.read.parquet(a.input), c.skip_exact_dedup, c.skip_clean, c.skip_simhash, c.cross_dedup, c.exact_mode, c.prefix_len, c.simhash_threshold, c.sources, table=conversion_table([r[0] for r in spark.read.text(c.zh_table).collect()]) if c.zh_table else ("", ""))
        rows.write.mode("overwrite").partitionBy("source").parquet(a.output)
    else:
        writers.write_splits(build(spark.read.parquet(a.input), c.variant, c.max_chars), a.output)
    sweep(spark, before)


if __name__ == "__main__":
    main()
