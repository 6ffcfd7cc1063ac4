"""Quality labels, scores and evaluation roll-ups."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.text import map_score
from loomtext.sources.writers import write_report


def label_distribution(spark: SparkSession, labels: DataFrame, column: str = "score") -> DataFrame:
    """Q2. Rows and percentage for scores 1 to 5, none left out, with the class of each score."""
    counts = labels.groupBy(F.col(column).cast("int").alias("score")).agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    every = spark.range(1, 6).select(F.col("id").cast("int").alias("score"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "score", "left").crossJoin(total).select("score", map_score(F.col("score")).alias("label"), n.alias("n"), F.round(100 * n / F.greatest("total", F.lit(1)), 2).alias("percent"))


def train_quality(rows: DataFrame, features: int = 1 << 15) -> PipelineModel:
    """Q3. A softmax over hashed words and word pairs of (text, label)."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="\\s+", toLowercase=False)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    tf = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("words", "pairs")]
    join = VectorAssembler(inputCols=["words_tf", "pairs_tf"], outputCol="features")
    return Pipeline(stages=[words, pairs, *tf, join, LogisticRegression(maxIter=20, regParam=0.01, labelCol="label")]).fit(rows)


def score_all(model: PipelineModel, rows: DataFrame, min_len: int = 20, max_len: int = 3000) -> DataFrame:
    """Q4. ``rows`` with ``quality``: 0 for texts under min_len, else the model's label of the first max_len characters."""
    cut = rows.withColumn("_full", F.col("text")).withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, max_len))
    scored = model.transform(cut)
    return scored.select(*[F.col("_full").alias("text") if c == "text" else c for c in rows.columns], F.when(F.length("_full") < min_len, 0).otherwise(F.col("prediction").cast("int")).alias("quality"))


def precision_recall(scored: DataFrame, truth: str, guess: str) -> DataFrame:
    """Q3. Rows and P@1 = R@1."""
    return scored.agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), 6).alias("p_at_1"))


def perplexity(losses: DataFrame, *keys: str) -> DataFrame:
    """V1, V2. exp(sum of losses / tokens) by ``keys``."""
    return losses.groupBy(*keys).agg(F.sum("loss").alias("loss"), F.sum("tokens").alias("tokens")).withColumn("ppl", F.exp(F.col("loss") / F.greatest(F.lit(1), F.col("tokens"))))


def accuracy(answers: DataFrame) -> DataFrame:
    """V3, V4. Accuracy by subject and in total (subject null); a missing subject is general."""
    rows = answers.withColumn("subject", F.coalesce("subject", F.lit("general")))
    return rows.rollup("subject").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))


def best_option(scores: DataFrame, key: str) -> DataFrame:
    """V5. The option of the best mean log-probability, the first of equals; an option without tokens is last."""
    mean = F.when(F.col("tokens") > 0, F.col("log_prob") / F.col("tokens")).otherwise(F.lit(float("-inf")))
    return scores.groupBy(key).agg(F.max_by("option", F.struct(mean, -F.col("option_no"))).alias("choice"))


def knowledge(results: DataFrame) -> DataFrame:
    """V6. Counts and rates of verdicts (CORRECT, WRONG, HALLUCINATION)."""
    n = F.count("*")
    parts = [(s.lower(), F.count_if(F.col("verdict") == s)) for s in ("CORRECT", "WRONG", "HALLUCINATION")]
    return results.agg(n.alias("n"), *[c.alias(k) for k, c in parts], *[F.round(c / F.greatest(n, F.lit(1)), 4).alias(f"{k}_rate") for k, c in parts])


def consistency(hits: DataFrame, group: str) -> DataFrame:
    """V6. By group: hits, and whether they pass the two rules, two hits, or 0.67 of all."""
    return hits.groupBy(group).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).select(group, "n", "hits", (F.col("hits") >= 2).alias("two"), (F.col("hits") >= 0.67 * F.col("n")).alias("share"))


def report(parts: dict[str, DataFrame], benchmarks: str = "ppl,knowledge") -> dict:
    """V7. The named results (a list with commas) as plain rows; each is a small aggregate. An unknown name is an error."""
    wanted = [x.strip() for x in benchmarks.split(",") if x.strip()]
    if unknown := [x for x in wanted if x not in parts]:
        raise ValueError(f"no results for: {', '.join(unknown)}")
    return {name: [r.asDict() for r in parts[name].collect()] for name in wanted}


def run_report(spark: SparkSession, parts: dict[str, DataFrame], model: str, folder: str, benchmarks: str = "ppl,knowledge", output: str = "") -> str:
    """V7, K8. The report as one JSON document with ``_meta``, under ``output`` or eval_{model}_{time} in ``folder``; the
    path."""
    now = datetime.now()
    path = output or f"{folder}/eval_{os.path.splitext(os.path.basename(model))[0]}_{now:%Y%m%d_%H%M%S}.json"
    write_report(spark, report(parts, benchmarks), path, {"model": model, "timestamp": now.isoformat()})
    return path


def loss_spikes(log: DataFrame, factor: float = 6.0) -> DataFrame:
    """N7. Steps whose loss is over ``factor`` times the loss before, by run."""
    before = F.lag("loss").over(Window.partitionBy("run").orderBy("step"))
    return log.withColumn("spike", F.coalesce(F.col("loss") > factor * before, F.lit(False)))
