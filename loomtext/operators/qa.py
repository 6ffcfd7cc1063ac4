"""Question and answer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import parse_qa, qa_has_url, strip_ws
from loomtext.operators.dedup import first_of
from loomtext.plans.session import checkpointed


def judged_qa(rows: DataFrame, order: str, min_answer: int = 20) -> DataFrame:
    """D11. Rows with ``q``, ``a`` and ``status``: unparsed, short, url, duplicate or kept. A duplicate has the question
    of an earlier row that got as far."""
    parsed = rows.withColumn("_qa", parse_qa(F.col("text"))).select("*", "_qa.q", "_qa.a").drop("_qa")
    early = F.when(F.col("q").isNull(), "unparsed").when(F.length("a") < min_answer, "short").when(qa_has_url(F.col("q"), F.col("a")), "url")
    staged = checkpointed(parsed.withColumn("status", early), "parsed")  # both sides of the join read it
    first = staged.where("status is null").groupBy(F.md5("q").alias("_k")).agg(F.min(order).alias("_first"))
    met = staged.join(first, (F.md5(staged["q"]) == F.col("_k")) & staged["status"].isNull(), "left")
    return met.withColumn("status", F.coalesce("status", F.when(F.col(order) == F.col("_first"), "kept").otherwise("duplicate"))).drop("_k", "_first")


def filter_qa(rows: DataFrame, order: str, min_answer: int = 20) -> DataFrame:
    """D11. The original rows that are kept."""
    return judged_qa(rows, order, min_answer).where("status = 'kept'").select(*rows.columns)


def qa_stats(judged: DataFrame) -> DataFrame:
    """Counters of ``judged_qa``; unparsed rows count in total only."""
    return judged.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("kept", "kept"), ("short", "short"), ("url", "url"), ("duplicate", "dup"))])


def dedup_questions(rows: DataFrame, order: str) -> DataFrame:
    """D10. First row of each question (column q)."""
    return first_of(rows.where(strip_ws(F.col("q")) != ""), F.md5("q"), order)
