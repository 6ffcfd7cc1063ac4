"""Text functions against Python's own regular expressions and known cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def noise(seed, n=300):
    rnd = random.Random(seed)
    parts = ["a", "B", "中", "文", " ", "\n", "\t", "　", " ", "\x1c", " ", "<p>", "</b>", "<3", "< b", "http://x.y/z", "https://中", "。", "！", "é", "😀"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(n)]


def test_cleaned_equals_python(spark):
    values = noise(1)
    want = [" ".join(re.sub(r"https?://\S+", "", re.sub(r"</?[a-zA-Z][^>]*>", "", v)).split()) for v in values]
    assert apply(spark, T.cleaned, values) == want


@pytest.mark.parametrize(("value", "reason"), [("", "empty"), (None, "empty"), ("a" * 9, "length"), ("a" * 10, None), ("a" * 2000, None), ("a" * 2001, "length"), ("1" * 8 + "ab" + "c", "letters"), ("1" * 7 + "abc", None)])
def test_reject_reason(spark, value, reason):
    assert apply(spark, lambda x: T.reject_reason(T.cleaned(x), x), [value]) == [reason]


def test_zh_ratio_boundary(spark):
    got = apply(spark, lambda x: T.reject_reason(x, x, zh=0.15), ["中" * 3 + "a" * 17, "中" * 2 + "a" * 18])
    assert got == [None, "zh_ratio"]


ADS = {"咨询热线：400123": True, "咨询：400123": False, "订购电话13800": True, "线：12345": True, "线12345": False, "qQ：12345": True, "QQ：1234": False, "vx:abc": True, "扫一扫": True, "点击下面链接": True, "010-12-34567": False, "010-1234-56789": True, "分店遍布": True, "优惠开启": True, "跳楼价": True, "火爆进行中": True, "电话：１２３": True}


def test_ads(spark):
    assert apply(spark, T.is_ad, list(ADS)) == list(ADS.values())


def test_wiki(spark):
    cases = {"该镇镇区人口有5人": True, "美国2000年人口普查": True, "美国\n人口普查": False, "海拔高度为5英尺": True, "海拔高度为": False}
    assert apply(spark, T.is_wiki_junk, list(cases)) == list(cases.values())


def test_prefix_and_markdown(spark):
    assert apply(spark, T.clean_prefix, ["A: 中文", "ABA: X", "B:Text  y", "a b"]) == ["中文", "ABA: X", "Text y", "a b"]
    values = ["**b** *i*", "# h\ntext", "1. x\n- y", "a\n\n\n\nb", "a*b", "**a\nb**"]
    assert apply(spark, lambda x: T.clean_markdown(x)[0], values) == ["b i", "h\ntext", "x\ny", "a\n\nb", "a*b", "**a\nb**"]


QA = {
    "问题：什么 回答：答案": ("什么", "答案"), "Q: what A: that": ("what", "that"), "q：what\ta：that": ("what", "that"), "Q:whatA:that": (None, None), "问: 甲 答：乙": ("甲", "乙"),
    '{"question": "x", "answer": "y"}': ("x", "y"), "abc\tlong answer": ("abc", "long answer"), "ab\tlong answer": (None, None), "abc\tshort": (None, None), "plain": (None, None), "问题：  回答：x": (None, None), "": (None, None),
}


def test_parse_qa(spark):
    got = apply(spark, T.parse_qa, list(QA))
    assert [(g.q, g.a) for g in got] == list(QA.values())


def test_conversion_table(spark):
    table = T.conversion_table(["# from, to", "漢\t汉", "", "語\t语\n", "漢\t漢"])
    assert table == ("漢語", "汉语") and apply(spark, lambda x: T.traditional(x, *table), ["漢語 x漢", None]) == ["汉语 x汉", None]
    with pytest.raises(ValueError):
        T.conversion_table(["ab\tc"])


def test_chatml(spark):
    rows = spark.createDataFrame([([("user", "你好"), ("assistant", "x")],)], "m array<struct<role:string,content:string>>")
    one = rows.select(T.chatml(F.col("m")), T.chatml(F.col("m"), prompt=True)).first()
    assert one[0] == "<|im_start|>user\n你好<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    lost = spark.createDataFrame([([("user", None), (None, "x")],)], "m array<struct<role:string,content:string>>")
    assert lost.select(T.chatml(F.col("m"))).first()[0] == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert one[1] == one[0] + "<|im_start|>assistant\n"


def test_scores_and_prompts(spark):
    assert apply(spark, T.parse_score, ["4", "4/5", "no", "0", "Score: 3.", "４", "٣ of ten", "4²", "05", None]) == [4, None, None, None, 3, 4, 3, None, 5, None]
    rows = spark.createDataFrame([("1+1=?", ["1", None, "3"])], "q string, o array<string>")
    assert rows.select(T.choice_prompt(F.col("q"), F.col("o"))).first()[0] == "1+1=?\nA. 1\nB. 3\n答案："


def test_check_answer(spark):
    rows = spark.createDataFrame([("abc def", "abcdef", ["x"]), ("an x", "none", ["x"]), ("zz", "none", ["x"])], "g string, e string, k array<string>")
    assert [r[0] for r in rows.select(T.check_answer(F.col("g"), F.col("e"), F.col("k"))).collect()] == ["CORRECT", "HALLUCINATION", "WRONG"]


def test_follow_ups_and_variants(spark):
    good = '```json\n{"follow_ups": [{"user": "a", "assistant": "b"}, {"user": "a"}]}\n```'
    got = apply(spark, T.follow_ups, [good, '[{"user": "a", "assistant": "b"}]', "no"])
    assert [len(x) for x in got] == [1, 1, 0]
    assert apply(spark, lambda x: T.variant_lines(x, F.lit("seed text"), 2), ["1. first one\n2. seed text\n- first one\n3) abc\n4、 second\n5. third"]) == [["first one", "second"]]
