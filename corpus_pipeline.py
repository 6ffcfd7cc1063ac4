"""From raw documents to training ids: quality rules, line dedup, near-dedup, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and gives back the rows that go on, with the columns of ``documents``; the last
one gives the encoded documents. Every stage judges what its predecessor kept, and nothing else.

Defined cases, by stage. Extra columns go through the first four stages as they are, whatever their names; the fifth gives
its own. An empty table gives an empty one everywhere. Texts of any length are judged whole.

* quality: a null, empty or blank text has no words and goes; a null doc_id or a repeated row is judged by its own text.
* lines: a null or empty text loses nothing and stays; rows without a doc_id stay as they are; rows that share a doc_id are
  no partners of each other; ``n_chars`` is counted anew where lines went, if the table has it.
* near: a document without words is no near copy and stays; of rows equal in doc_id and text one stays; rows that share a
  doc_id but not the text are judged each by its own; rows without a doc_id stay if their group has no doc_id, else go.
* leaks: a text that holds a benchmark window goes, wherever it stands; a null or empty one stays.
* encode: one row for each row; a null text has no pieces and decodes to the empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontamination, line_dedup, minhash, pieces, quality_rules
from loomtext.llm.common import free_name, keep
from loomtext.llm.queries import table, vocabulary
from loomtext.plans.session import kept, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``."""
    return quality_rules.keep_rows(docs, *quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents of which nothing is left go."""
    found = free_name(docs, "line_dedup")
    done = line_dedup.marked(docs, name=found)
    n, of, text = (F.col(f"{found}.{c}") for c in ("n_deleted", "n_lines", "kept"))
    new = {"text": text} | ({"n_chars": F.when(n > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return done.where((n == 0) | (n < of)).withColumns(new).select(*[f"`{c}`" for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near duplicates."""
    return minhash.dedup(docs, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. What is found is told by a hash of the text, so that each row goes
    or stays by its own."""
    version = free_name(docs, "version")
    found = decontamination.run(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaking = found.where("contaminated").select(F.col("doc_id").alias(version)).distinct()
    return docs.join(leaking, F.xxhash64(docs["text"]) == leaking[version], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip, ids)."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("decontamination", leaks), ("piece encoding", encode)]

#: Alignment, near duplicates and piece encoding are beyond SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's input. Tables
    that a stage made for itself are deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), kept()
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, {*before, docs.kept_at})
    return docs
