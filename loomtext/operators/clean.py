"""Cleaning jobs over documents (C10-C14, C18) and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.numeric import once


def clean(docs: DataFrame, **options) -> DataFrame:
    """C10. ``docs`` with ``clean`` and ``reason``; kept rows have a null reason."""
    table = options.pop("table", ("", ""))
    return docs.withColumn("clean", T.cleaned(F.col("text"), table)).withColumn("reason", once(T.reject_reason(F.col("clean"), F.col("text"), **options)))


def clean_stats(cleaned: DataFrame, *keys: str) -> DataFrame:
    """C11. Rows in, rows kept and the percentage, by ``keys``."""
    kept = F.count_if(F.col("reason").isNull())
    return cleaned.groupBy(*keys).agg(F.count("*").alias("total"), kept.alias("kept"), F.round(100 * kept / F.count("*"), 2).alias("percent"))


def clean_answers(rows: DataFrame, mode: str = "all") -> DataFrame:
    """C14. ``output`` without stray prefixes and marks; rows without one pass. ``changed`` names what changed."""
    out, changes = F.col("output"), []
    if mode in ("prefix", "all"):
        after = T.clean_prefix(out)
        changes.append(F.when(after != out, "prefix"))
        out = after
    if mode in ("markdown", "all"):
        after, flags = T.clean_markdown(out)
        changes += [F.when(f, n) for n, f in flags.items()]
        out = after
    return rows.withColumns({"changed": F.array_compact(F.array(*changes)), "output": F.when(F.col("output").isNotNull(), out)})
