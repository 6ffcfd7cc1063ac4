"""Sinks, the command line, settings files and the shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import dedup, evaluate, mix
from loomtext.plans import config, corpus, session
from loomtext.sources import readers, writers


def test_lines_and_splits(spark, tmp_path):
    d = spark.createDataFrame([("a", "train"), ("b\tc", "test")], "text string, split string")
    writers.write_lines(d, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b\tc"]
    for _ in range(2):  # the second run goes over the first
        writers.write_splits(d, str(tmp_path / "splits"))
    assert sorted((r.split, r.value) for r in spark.read.text(str(tmp_path / "splits")).collect()) == [("test", "<|im_start|>b\tc<|im_end|>"), ("train", "<|im_start|>a<|im_end|>")]


def test_json_lines_keep_their_characters(spark, tmp_path):
    writers.write_jsonl(spark.createDataFrame([("中文 é",)], "x string"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"x":"中文 é"}']


def test_fingerprints_tokens_report(spark, tmp_path):
    writers.write_fingerprints(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "source string, fp long"), str(tmp_path / "fp"))
    assert spark.read.parquet(str(tmp_path / "fp")).count() == 2
    one, two = (spark.createDataFrame([([k],)], "ids array<int>") for k in (1, 2))
    path = writers.write_tokens(one, str(tmp_path), "t1")
    assert writers.write_tokens(two, str(tmp_path), "t1") == path and spark.read.parquet(path).first().ids == [1]  # reused
    assert spark.read.parquet(writers.write_tokens(two, str(tmp_path), "t2")).first().ids == [2]
    assert writers.done(spark, path) and not writers.done(spark, str(tmp_path / "nothing"))
    parts = {"ppl": spark.createDataFrame([(2.0,)], "ppl double"), "knowledge": spark.createDataFrame([(3,)], "correct int")}
    out = evaluate.run_report(spark, parts, "runs/best.pt", str(tmp_path), "ppl")
    said = json.loads(spark.read.text(out).first()[0])
    assert "/eval_best_" in out and said["ppl"] == [{"ppl": 2.0}] and said["_meta"]["model"] == "runs/best.pt" and "knowledge" not in said
    with pytest.raises(ValueError):
        evaluate.report(parts, "ppl,nope")


def test_command_line(spark, tmp_path):
    lines = [json.dumps({"title": "t", "desc": "", "content": "c" * 40}), "broken"]
    (tmp_path / "news.jsonl").write_text("\n".join(lines))
    corpus.main(["extract", "--input", str(tmp_path / "news.jsonl"), "--format", "news", "--output", str(tmp_path / "out")])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["t。" + "c" * 40]
    long = "一段足够长的中文文本用来测试清洗流程是否正确工作，" * 2
    spark.createDataFrame([(0, "wiki", long), (1, "wiki", long), (2, "wiki", "短")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "s.json").write_text('{"skip_clean": true, "skip_simhash": true}')
    for more, n in (([], 1), (["--config", str(tmp_path / "s.json")], 2)):
        corpus.main(["pipeline", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "kept"), *more])
        assert spark.read.parquet(str(tmp_path / "kept")).count() == n
    corpus.main(["build", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "built"), "--variant", "lite"])
    assert spark.read.text(str(tmp_path / "built")).count() == 3


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text('{"prefix_len": 50, "variant": "lite"}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "prefix_len": 70, "sources": ["wiki"]}')
    got = config.load(tmp_path / "own.json")
    assert (got.prefix_len, got.variant, got.sources, got.simhash_threshold) == (70, "lite", ["wiki"], 3)
    (tmp_path / "bad.json").write_text('{"prefix_len": 0, "skip_clean": 1, "other": 2}')
    with pytest.raises(config.SettingsError, match="prefix_len.*skip_clean.*other"):
        config.load(tmp_path / "bad.json")
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(config.SettingsError):
        config.load(tmp_path / "loop.json")


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "law.json").write_text('[{"question": "a"}, {"question": "b", "subject": "own"}]')
    (tmp_path / "art.json").write_text('[{"question": "c"}]')
    got = sorted((r.question, r.subject) for r in readers.benchmark_items(spark, str(tmp_path)).collect())
    assert got == [("a", "law"), ("b", "own"), ("c", "art")]
    some = mix.of_subjects(readers.benchmark_items(spark, str(tmp_path)), ["law", "art"])
    assert sorted(r.question for r in some.collect()) == ["a", "c"] and mix.of_subjects(some).count() == 2
    (tmp_path / "ceval.json").write_text('[{"question": "only"}]')
    assert [(r.question, r.subject) for r in readers.benchmark_items(spark, str(tmp_path)).collect()] == [("only", None)]


def test_topics_and_first_stage(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one \n\n\t\ntwo\n")
    assert [r.topic for r in readers.topics(readers.lines(spark, str(tmp_path / "t.txt"))).collect()] == ["one", "two"]
    assert readers.first_stage(spark, str(tmp_path), "wiki") is None
    (tmp_path / "wiki_clean.txt").write_text("x")
    (tmp_path / "wiki_trunc.txt").write_text("")
    assert readers.first_stage(spark, str(tmp_path), "wiki").endswith("wiki_clean.txt")
    (tmp_path / "wiki_dedup.txt").write_text("y")
    assert readers.first_stage(spark, str(tmp_path), "wiki").endswith("wiki_dedup.txt")


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Spark:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark)


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    assert session.spread(spark, path).count() == 1000 and session.spread(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL", 1)
    assert session.spread(spark, path).rdd.getNumPartitions() == 1


def test_first_of_aggregates_keys_only(spark):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = dedup.first_of(d, F.md5("text"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
