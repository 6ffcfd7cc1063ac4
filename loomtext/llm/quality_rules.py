"""Learned decision lists for document quality, all in DataFrame expressions.

``statistics`` turns a text into counts and shares with built-in functions only. ``learn`` fits an ordered list of
threshold conjunctions by sequential covering on labelled statistics: a rule grows literal by literal while it gains
information (FOIL gain) on the growing two thirds of the labelled rows, is pruned from its end while that raises
(p - n) / (p + n) on the other third, and is kept if it is precise there; the bad rows that it covers leave, and the next
rule grows. A word list, learned from the same rows, gives one more statistic: the number of a text's distinct words that
stand almost only in bad documents. ``verdict`` emits the list as one ordered CASE expression.

The labelled rows that the rules are fitted on are bounded by ``LABEL_ROWS`` (taken by hash of the doc_id); they are the
only rows that reach the driver. Statistics and verdicts cover every document and all of its text.

The fitted list is bounded: at most ``RULES`` rules of ``LITERALS`` literals, thresholds at ``CUTS`` quantiles; the word
list holds all words that pass its test. Repeated windows are told by a 64-bit hash: in a text of 10**6 words two different
ones meet with probability 3e-8.

Defined cases: a null, empty or blank text has no words, zero counts and fails the base; labels with a null doc_id,
without a document or with null values count as good in that value or not at all; a doc_id that is labelled several times
is bad if any row says so; no labels, or none that is bad, give an empty list, so that the base alone decides; of literals with equal gain the first statistic and lower threshold
wins, and of rules that hold the first decides; equal rows are judged alike, row by row; a text of any length is judged
whole, in one row's memory. Extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.numeric import let

from .common import keep, release

#: Labelled rows that a list is fitted on, at most.
LABEL_ROWS = 20_000
#: Thresholds tried for each statistic and direction, literals in a rule, rules in a list.
CUTS, LITERALS, RULES = 24, 4, 12
#: What a rule needs on the pruning rows, and a word on the labelled rows.
PRECISION, WORD_PRECISION, LEAST = 0.9, 0.9, 5
SPACE = "[\\x20\\x09-\\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "n_marked"]
Rule = list[tuple[str, str, float]]


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 5-word window found twice or more. Windows are compared by 64-bit hash."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])

        return let(pairs, twice)

    return F.when(F.size(words) < 6, 0).otherwise(let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def statistics(docs: DataFrame, marked: list[str], carry: bool = False) -> DataFrame:
    """(doc_id, counts, shares) of ``docs`` (doc_id, text), with the whole row as a struct ``row`` if ``carry``."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    also = ["row"] * carry
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row).select(*also, "doc_id", "text", words_of(F.col("text")).alias("w"), lines.alias("l"))
    letters = F.split(F.lower("text"), "[^\\p{L}]+") if marked else None
    counted = base.select(
        *also,
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("l").alias("n_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("n_upper"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        (F.size(F.array_intersect(letters, F.array(*map(F.lit, marked)))) if marked else F.lit(0)).cast("double").alias("n_marked"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        *also, "doc_id", *COUNTS, share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_distinct", "n_words").alias("distinct_share"), "n_marked",
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, bad) of at most LABEL_ROWS labelled documents; the label side is that small, so it is broadcast."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(bad).alias("bad"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(LABEL_ROWS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "bad")


def marked_words(rows: DataFrame) -> list[str]:
    """All words that stand almost only in bad documents, the most frequent first; their number is bounded by LABEL_ROWS."""
    # copies of a text count once, else the words of a text that is copied often would look like evidence
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("bad").alias("bad"))
    words = once.select("bad", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+"))).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n")).where((F.col("n_bad") >= 2 * LEAST) & (F.col("n_bad") >= WORD_PRECISION * F.col("n")))
    return [r["word"] for r in counted.orderBy(F.desc("n_bad"), "word").collect()]


def grow(rows: list[tuple[tuple[float, ...], bool, bool]]) -> list[Rule]:
    """An ordered list of rules for rows (values of SHARES, bad, in the growing set). Sets of rows are integers' bits."""
    every = (1 << len(rows)) - 1
    bad = sum(1 << k for k, r in enumerate(rows) if r[1])
    growing = sum(1 << k for k, r in enumerate(rows) if r[2])
    literals: list[tuple[tuple[str, str, float], int]] = []
    for f, name in enumerate(SHARES):
        order = sorted(range(len(rows)), key=lambda k: rows[k][0][f])
        values = [rows[k][0][f] for k in order]
        of_bad = [v for k, v in zip(order, values, strict=True) if rows[k][1]]
        cuts = sorted({x[int(q * (len(x) - 1) / CUTS)] for x in (values, of_bad) if x for q in range(CUTS + 1)})
        at, below = 0, 0
        for cut in cuts:
            while at < len(order) and values[at] < cut:
                below |= 1 << order[at]
                at += 1
            literals.append(((name, ">=", cut), every & ~below))
            if below:
                literals.append(((name, "<", cut), below))
    rules: list[Rule] = []
    left = every
    while len(rules) < RULES:
        rule, held = [], [left]
        while len(rule) < LITERALS:
            here = held[-1] & growing
            p0, n0 = (here & bad).bit_count(), (here & ~bad).bit_count()
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for k, (_, rows_in) in enumerate(literals):
                p = (here & rows_in & bad).bit_count()
                if p >= LEAST and (g := p * (log2(p / (p + (here & rows_in & ~bad).bit_count())) - log2(p0 / (p0 + n0)))) > gain:
                    best, gain = k, g
            if best is None:
                break
            rule.append(literals[best][0])
            held.append(held[-1] & literals[best][1])

        def worth(s: int) -> float:
            p, n = (s & ~growing & bad).bit_count(), (s & ~growing & ~bad).bit_count()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(held[-2]) >= worth(held[-1]):
            rule.pop()
            held.pop()
        p, n = (held[-1] & ~growing & bad).bit_count(), (held[-1] & ~growing & ~bad).bit_count()
        if not rule or p < LEAST or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~held[-1]
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[Rule], list[str]]:
    """The decision list and the word list that labelled documents give."""
    rows = keep(labelled(docs, labels), "labelled")  # bounded; the documents are read for it once
    marked = marked_words(rows)
    known = statistics(rows, marked).join(rows.select(F.col("doc_id").alias("id"), "bad").distinct(), F.col("doc_id") == F.col("id"))
    taken = known.select(*[F.col(c).cast("double") for c in SHARES], "bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("growing")).orderBy("doc_id").limit(LABEL_ROWS).collect()
    release(docs.sparkSession, rows)
    return grow([(tuple(r[c] for c in SHARES), r["bad"], r["growing"]) for r in taken]), marked


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, cut in rule:
        out = out & (F.col(name) >= cut if sign == ">=" else F.col(name) < cut)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, 0 for none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(condition(rules[k - 1]), k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], marked: list[str]) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rule) for every document."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = statistics(docs, marked).select("doc_id", *COUNTS, failed.alias("base_failed"), verdict(rules).alias("rule"))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_rows(docs: DataFrame, rules: list[Rule], marked: list[str]) -> DataFrame:
    """The rows of ``docs`` that are kept, in the one pass that judges them. The partition number among the statistics
    keeps the filter above them: below, it would compute them again for each of its terms."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = statistics(docs, marked, carry=True).select("row", failed.alias("base_failed"), verdict(rules).alias("rule"), F.spark_partition_id().alias("guard"))
    return judged.where(~F.col("base_failed") & (F.col("rule") == 0) & (F.col("guard") >= 0)).select("row.*")


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, *learn(docs, labels))
