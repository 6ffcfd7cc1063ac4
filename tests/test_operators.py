"""Operators against literal restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import numeric as N
from loomtext.operators import chunk, dedup, evaluate, mix, qa, tokenizer, tuning
from loomtext.plans import corpus
from loomtext.sources import readers


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(k, t, source if isinstance(source, str) else source[k]) for k, t in enumerate(texts)], "doc_id long, text string, source string")


def simhash(text):
    import hashlib

    h = lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big")
    if len(text) < 3:
        v = h(text)
    else:
        sums = [0] * 64
        for k in range(len(text) - 2):
            x = h(text[k : k + 3])
            for b in range(64):
                sums[b] += 1 if x >> b & 1 else -1
        v = sum(1 << b for b in range(64) if sums[b] > 0)
    return v


def test_simhash_restated(spark):
    rnd = random.Random(2)
    texts = ["a", "ab", "abc", "aaaa", "中文字", "😀😀😀x"] + ["".join(rnd.choice("ab 中😀") for _ in range(rnd.randrange(3, 60))) for _ in range(60)]
    got = {r.doc_id: r.fp % (1 << 64) for r in dedup.fingerprints(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        t = " ".join(t.split())
        if t:
            assert got[k] == simhash(t), t


@pytest.mark.parametrize("threshold", [0, 3, 8])
def test_greedy_dedup(spark, threshold):
    rnd = random.Random(threshold)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(80)) for _ in range(6)]
    texts = [base[k % 6][: 40 + k] + rnd.choice(["", "x", "yy"]) for k in range(60)]
    kept, want = [], []
    for k, t in enumerate(texts):
        f = simhash(" ".join(t.split()))
        bands = {(b, f >> 16 * b & 65535) for b in range(4)}
        if not any(bin(f ^ g).count("1") <= threshold and bands & c for g, c in kept):
            kept.append((f, bands))
            want.append(k)
    got = sorted(r.doc_id for r in dedup.dedup_simhash(docs(spark, texts), threshold).collect())
    assert got == want


def test_exact_and_prefix(spark):
    d = docs(spark, ["a  b", "a b", "", "  ", None, "x" * 100 + "1", "x" * 100 + "2"])
    assert sorted((r.doc_id, r.text[:3]) for r in dedup.dedup_exact(d).collect()) == [(0, "a b"), (5, "xxx"), (6, "xxx")]
    assert sorted(r.doc_id for r in dedup.dedup_prefix(d).collect()) == [0, 5]
    assert dedup.dedup_stats(d, dedup.dedup_exact(d)).first().asDict() == {"total": 7, "kept": 3, "deduped": 1}


def test_cross_source_goes_on_both_sides(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    d = docs(spark, [t, t, "another text that is unlike the others here", t], ["a", "b", "a", "qa"])
    assert sorted(r.doc_id for r in dedup.dedup_cross(d).collect()) == [2, 3]
    assert sorted(r.doc_id for r in dedup.dedup_cross(d, keep_first="doc_id").collect()) == [0, 2, 3]


def test_cross_source_bands_are_not_broadcast(spark, capsys):
    d = docs(spark, ["the quick brown fox jumps over the lazy dog", "another text that is unlike the others"], ["a", "b"])
    dedup.dedup_cross(d).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_simhash_counts_in_groups(monkeypatch):
    import pandas as pd

    rnd = random.Random(8)
    texts = ["", "ab", "abc"] + ["".join(rnd.choice("ab 中😀") for _ in range(rnd.randrange(3, 90))) for _ in range(40)]
    sizes, unique = [], dedup.np.unique
    monkeypatch.setattr(dedup, "GRAMS", 16)
    monkeypatch.setattr(dedup.np, "unique", lambda x, **more: sizes.append(len(x)) or unique(x, **more))
    assert [int(v) % (1 << 64) for v in dedup._simhash(pd.Series(texts))] == [simhash(t) for t in texts]
    assert max(sizes) <= 16


def test_filter_qa(spark):
    long = "an answer that is long enough to stay"
    d = docs(spark, [f"Q: one A: {long}", "Q: two A: short", f"Q: three A: {long} www.x.y", f"Q: one A: {long} too", "nothing"])
    got = {r.doc_id: r.status for r in qa.judged_qa(d, "doc_id").collect()}
    assert got == {0: "kept", 1: "short", 2: "url", 3: "duplicate", 4: "unparsed"}
    assert [r.doc_id for r in qa.filter_qa(d, "doc_id").collect()] == [0]


def test_bands_find_every_near_pair(spark):
    rnd = random.Random(9)
    values = []
    for _ in range(150):
        v = rnd.getrandbits(64)
        values += [v, *(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5))) for _ in range(3))]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = [tuple(r) for r in dedup.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_char_weights_golden(spark):
    sizes = spark.createDataFrame([("wiki", 123.0), ("baike", 145.0), ("news", 752.0), ("qa", 192.0)], "source string, mean_chars double")
    shares = spark.createDataFrame([("wiki", 0.30), ("baike", 0.12), ("news", 0.43), ("qa", 0.15), ("gone", 0.1)], "source string, ratio double")
    got = {r.source: round(100 * r.weight, 1) for r in mix.char_weights(sizes, shares).collect()}
    assert got == {"wiki": 52.8, "baike": 17.9, "news": 12.4, "qa": 16.9}


def test_splits_disjoint_and_complete(spark):
    d = docs(spark, [f" t{k}\u3000" for k in range(500)] + [" ", "\t\n", "\u3000", ""])
    assert all(r.text == f"t{r.doc_id}" for r in mix.assign_splits(d).collect())
    got = mix.assign_splits(d).groupBy("split").count().collect()
    assert sum(r["count"] for r in got) == 500
    assert {r["split"] for r in got} == {"train", "valid", "test"}
    with pytest.raises(ValueError):
        mix.assign_splits(d, ratios=[0.5], sources=["a", "b"])


def test_max_chars(spark):
    got = mix.max_chars(docs(spark, ["abc", "defg", "hij"]), 5).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["abc", "de"]


def pack(text, n):
    import re

    out, buf = [], ""
    for p in filter(None, re.split("([。！？；\n]+)", text)):
        if len(buf) + len(p) > n and buf:
            out.append(buf)
            buf = ""
        if len(p) > n:
            out += [p[k : k + n] for k in range(0, len(p), n)]
        else:
            buf += p
    return out + [buf] * bool(buf)


def test_pack(spark):
    rnd = random.Random(5)
    texts = ["！！", "。a", "abcd", "abcdefghijk", "ab。cd！e", ""] + ["".join(rnd.choice("ab。！\n") for _ in range(rnd.randrange(40))) for _ in range(80)]
    got = docs(spark, texts).orderBy("doc_id").select(chunk.pack(F.col("text"), 5)).collect()
    assert [list(r[0]) for r in got] == [pack(t, 5) for t in texts]


def packed_lines(lines, n):
    """The reading of a file line by line, restated: (line and sentence where a chunk begins, slice, chunk)."""
    import re

    out, buf, at = [], "", None
    for no, line in enumerate(lines):
        line = (line or "").strip()
        if not line:
            if buf:
                out.append((*at, 0, buf))
            buf = ""
            out.append((no, 0, 0, ""))
        for k, p in enumerate(filter(None, re.split("([。！？；\n]+)", line))):
            if (len(p) > n or len(buf) + len(p) > n) and buf:
                out.append((*at, 0, buf))
                buf = ""
            if len(p) > n:
                out += [(no, k, i // n, p[i : i + n]) for i in range(0, len(p), n)]
                continue
            at = at if buf else (no, k)
            buf += p
    return out + ([(*at, 0, buf)] if buf else [])


def test_pack_stream(spark):
    d = docs(spark, ["ab", "cd", "", "ef。gh", "ij"])
    got = chunk.pack_stream(d, "doc_id", 4).orderBy("doc_id", "piece").collect()
    assert [r.chunk for r in got] == ["abcd", "", "ef。", "ghij"]


@pytest.mark.parametrize("blanks", [0, 3])
def test_pack_stream_over_ranges(spark, blanks):
    """Two sources, one without any blank line: many ranges, chunks that go over several of them."""
    rnd = random.Random(blanks)
    line = lambda: "".join(rnd.choice("abc。！ ") for _ in range(rnd.randrange(1, 14)))
    texts = {"x": [line() for _ in range(400)], "y": [rnd.choice([line(), "a", *[" "] * blanks, None if blanks else "b", "z" * 45]) for _ in range(300)], "z": ["only one"]}
    rows = [(g, k, t) for g, ts in texts.items() for k, t in enumerate(ts)]
    rnd.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(rows, "g string, k long, text string")
        got = sorted((r.g, r.k, r.piece, r.slice, r.chunk) for r in chunk.pack_stream(d, "k", 20, "g").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((g, *c) for g, ts in texts.items() for c in packed_lines(ts, 20))
    assert chunk.pack_stream(d.where("k < 0"), "k", 20, "g").count() == 0


@pytest.mark.parametrize("n", [0, 7, 8, 9, 13, 14, 15, 16, 40])
def test_windows(spark, n):
    ids = list(range(n))
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(chunk.windows(F.col("ids"), 8, 6)).first()[0]
    count = max(0, (n - 9) // 6 + 1)
    assert [list(x) for x in got] == [ids[i * 6 : i * 6 + 9] for i in range(count)]


def test_collate(spark):
    d = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (0, [10, 20, 30])], "b int, ids array<int>")
    got = sorted((list(r.input), list(r.target)) for r in chunk.collate(d, "b").collect())
    assert got == [([1, 2, 3, 4], [2, 3, 4, 5]), ([10, 20, 30, 0], [20, 30, 0, 0])]


def bpe_restated(counts, size):
    words = {w: [b + 13 for b in w.encode()] for w in counts}
    merges = []
    while 269 + len(merges) < size:
        pairs = {}
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + counts[w]
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        new = 269 + len(merges)
        merges.append(best)
        for w, s in words.items():
            out = []
            for x in s:
                if out and (out[-1], x) == best:
                    out[-1] = new
                else:
                    out.append(x)
            words[w] = out
    return merges


def test_training_restated():
    rnd = random.Random(3)
    for _ in range(30):
        counts = {"".join(rnd.choice("aab é") for _ in range(rnd.randrange(1, 14))): rnd.randrange(1, 5) for _ in range(8)}
        assert tokenizer.train_on(counts, 300).merges == bpe_restated(counts, 300)


def test_tokenizer(spark):
    d = docs(spark, ["你好世界 hello hello world"] * 3 + ["hello 中文，测试"])
    t = tokenizer.train(d, 300)
    assert t.vocab_size <= 300 and t.merges
    for text in ["你好，世界！", "Hello, World!", "AI人工智能", "测试" * 500, "", "a<|im_start|><|im_end|>b", "😀 hello"]:
        assert t.decode(t.encode(text), skip_specials=False) == text
    assert t.encode("<|im_start|>") == [1] and t.encode("a", True, True)[::len(t.encode("a")) + 1] == [1, 2]
    assert tokenizer.Tokenizer.load(t.save()).encode("hello world") == t.encode("hello world")
    assert t.decode([10**6]) == "?" and t.token_id("nope") == 0
    with pytest.raises(TypeError):
        t.encode(None)
    got = d.select(tokenizer.decode_udf(t)(tokenizer.encode_udf(t)("text")).alias("x"), "text").collect()
    assert all(r.x == r.text for r in got)


def test_bpe_training_leaves_the_texts_to_the_executors(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(120)) + "aaaa中，<|im_start|>" for _ in range(20)]
    d = docs(spark, [*texts, None, ""])
    want = bpe_restated(tokenizer_words(texts), 340)
    held, merged = [], tokenizer._merges
    monkeypatch.setattr(tokenizer, "_merges", lambda w, *more: held.append(sum(map(len, w))) or merged(w, *more))
    assert tokenizer.train(d, 340).merges == want
    assert held and max(held) < sum(map(len, texts)) / 2
    monkeypatch.setattr(tokenizer, "PIECES", 0)
    assert tokenizer.train(d, 272).merges == want[:3]


def tokenizer_words(texts):
    counts = {}
    for t in texts:
        for w in tokenizer._WORD.findall(t):
            counts[w] = counts.get(w, 0) + 1
    return counts


def test_bpe_encodes_many_texts_at_once_alike():
    rnd = random.Random(6)
    some = ["a", "a", "b", " ", "é", "中", "，", "<|im_start|>", "<|", "\0", "\n", "😀"]
    for _ in range(20):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(60))) for _ in range(9)] + ["", "a" * 37]
        t = tokenizer.train_on(tokenizer_words(texts), 320)
        for marks in (False, True):
            assert [x.tolist() for x in t.encode_arrays(texts, marks, marks, rnd.choice([1, 50, 10**6]))] == [t.encode(x, marks, marks) for x in texts]


def test_sft_and_dpo(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7, 8])], "p array<int>, f array<int>")
    got = [r[0] for r in d.select(tuning.sft_item(F.col("p"), F.col("f"), 6)).collect()]
    assert (list(got[0].input), list(got[0].labels)) == ([1, 2, 3, 4, 0, 0], [-100, -100, 4, 5, -100, -100])
    assert (list(got[1].input), list(got[1].labels)) == ([3, 4, 5, 6, 7, 0], [-100, -100, -100, 7, 8, -100])
    s = d.select(tuning.dpo_side(F.col("p"), F.array(F.lit(9)), 4)).collect()
    assert (list(s[0][0].ids), list(s[0][0].mask)) == ([1, 2, 3, 9], [0.0, 0.0, 1.0])


def test_numbers(spark):
    step = lambda f, s: spark.range(1).select(f(F.lit(s))).first()[0]
    assert step(lambda s: N.lr_cosine(s, 1000), 5) == 0.5
    assert step(lambda s: N.lr_wsd(s, 1000), 400) == 1.0
    rows = spark.createDataFrame([([[0.0] * 5] * 3, [1, 2, 3], [1.0, 1.0, 0.0], [2.0, 5.0, 3.0, 1.0], [1])], "l array<array<double>>, i array<int>, m array<double>, x array<double>, h array<int>")
    assert math.isclose(rows.select(N.masked_log_prob(F.col("l"), F.col("i"), F.col("m"))).first()[0], 2 * math.log(0.2))
    assert rows.select(N.repetition_penalty(F.col("x"), F.col("h"), 2.0)).first()[0] == [2.0, 2.5, 3.0, 1.0]
    assert rows.select(N.top_k(F.col("x"), 2)).first()[0] == [None, 5.0, 3.0, None]
    assert rows.select(N.top_p(F.col("x"), 0.5)).first()[0] == [None, 5.0, None, None]
    assert rows.select(N.dpo_loss(F.lit(0.0), F.lit(17998.0), F.lit(0.0), F.lit(0.0))).first()[0] == pytest.approx(1799.8)
    assert math.isclose(rows.select(N.dpo_loss(F.lit(-1.0), F.lit(-2.0), F.lit(-1.0), F.lit(-2.0))).first()[0], math.log(2))


def test_evaluation(spark):
    d = spark.createDataFrame([("a", True), ("a", False), (None, True)], "subject string, correct boolean")
    got = {r.subject: r.accuracy for r in evaluate.accuracy(d).collect()}
    assert got == {"a": 0.5, "general": 1.0, None: 0.6667}
    labels = spark.createDataFrame([(1,), (1,), (4,)], "score int")
    assert [r.n for r in evaluate.label_distribution(spark, labels).orderBy("score").collect()] == [2, 0, 0, 1, 0]


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([('{"title": " a ", "content": "' + "c" * 30 + '"}',), ("broken",), ("",), ("5",)], "line string")
    read = readers.json_lines(rows, readers.RECORDS["news"])
    assert read.where("not valid").count() == 2
    assert [r.text for r in readers.extract_news(read.where("valid")).collect()] == ["a。" + "c" * 30]
    (tmp_path / "a.json").write_text('[{"text": "x"}, {"text": "y"}]')
    (tmp_path / "b.json").write_text('{"root": [{"text": "x"}]}')
    (tmp_path / "c.jsonl").write_text('{"text": "x"}\nbad\n{"text": "z"}\n')
    for name, n in (("a.json", 2), ("b.json", 1), ("c.jsonl", 2)):
        assert readers.json_file(spark, str(tmp_path / name), "text string").count() == n, name
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("big.txt", "x\n" * 50)
        z.writestr("my_train.json", "one\ntwo\n")
    assert [r.line for r in readers.archive_lines(spark, str(tmp_path / "z.zip")).collect()] == ["one", "two"]


def test_pipeline_plan(spark):
    long = "一段足够长的中文文本用来测试清洗流程是否正确工作，" * 2
    d = docs(spark, [long, long, "短", long + "不同的结尾和更多的内容在这里"], ["wiki"] * 4)
    assert sorted(r.doc_id for r in corpus.pipeline(d).collect())[0] == 0
    with pytest.raises(ValueError):
        corpus.pipeline(d, sources=["nope"])


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
