"""Fine-tuning and preference rows (S1-S9, P1-P5). Token ids come from any encoder of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.numeric import let
from loomtext.functions.text import chatml, uniform

IGNORE = -100


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) of turns (conv_id, turn, role, text), in order."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def detect_format(rows: DataFrame, order: str) -> DataFrame:
    """S1. Rows as ``messages``: of the first row's kind in multi mode, else messages or instruction and output, whichever
    a row has; others go. ``multi`` tells which."""
    talk = F.coalesce((F.size("messages") >= 2) & F.exists("messages", lambda m: m["role"] == "assistant"), F.lit(False))
    single = F.col("instruction").isNotNull() & F.col("output").isNotNull()
    mode = rows.agg(F.min_by(F.col("messages").isNotNull(), F.col(order)).alias("_multi"))
    pair = F.array(message("user", F.col("instruction")), message("assistant", F.col("output")))
    kept = rows.crossJoin(mode).where(talk | (~F.col("_multi") & single))
    return kept.select(*[c for c in rows.columns if c != "messages"], F.when(talk, F.col("messages")).otherwise(pair).alias("messages"), talk.alias("multi"))


def inject_system(messages: Column, key: Column, prompts: list[str], ratio: float = 0.2, seed: int = 42) -> Column:
    """S2. A system prompt before some rows: drawn by key, which one too."""
    u, v = uniform(seed, key), uniform(seed + 1, key)
    prompt = F.element_at(F.array(*map(F.lit, prompts)), (F.floor(v * len(prompts)) + 1).cast("int"))
    return F.when(u < ratio, F.concat(F.array(message("system", prompt)), messages)).otherwise(messages)


def sft_item(prompt: Column, full: Column, max_len: int, pad: int = 0) -> Column:
    """S3, S4. struct(input, labels) of prompt ids and all ids: cut on the left to max_len, shifted by one, labels of the
    prompt ignored but for its last place, both padded to max_len."""

    def item(both: Column) -> Column:
        ids, p = both["ids"], both["p"]
        n = F.greatest(F.lit(0), F.size(ids) - 1)
        labels = F.transform(F.slice(ids, F.lit(2), n), lambda x, i: F.when(i < p - 1, IGNORE).otherwise(x))
        rest = (F.lit(max_len) - n).cast("int")
        return F.struct(F.concat(F.slice(ids, F.lit(1), n), F.array_repeat(F.lit(pad), rest)).alias("input"), F.concat(labels, F.array_repeat(F.lit(IGNORE), rest)).alias("labels"))

    return let(_cut(prompt, full, max_len), item)


def _cut(prompt: Column, full: Column, max_len: int) -> Column:
    """struct(ids, p): the last max_len of all ids, and how many of the prompt's are among them."""

    def cut(x: Column) -> Column:
        lost = F.greatest(F.lit(0), F.size(x["full"]) - max_len)
        return F.struct(F.slice(x["full"], lost + 1, F.least(F.size(x["full"]), F.lit(max_len))).alias("ids"), F.greatest(F.lit(0), x["n"] - lost).alias("p"))

    return let(F.struct(full.alias("full"), F.size(prompt).alias("n")), cut)


def sft_rows(rows: DataFrame, encode: Callable[[Column], Column], max_len: int = 512) -> DataFrame:
    """S3, S4. ``rows`` with (input, labels) of ``messages``; the last message is what is learned."""
    before = F.slice("messages", F.lit(1), F.size("messages") - 1)
    both = rows.withColumns({"_p": encode(chatml(before, prompt=True)), "_f": encode(chatml(F.col("messages")))})
    return both.withColumn("_i", sft_item(F.col("_p"), F.col("_f"), max_len)).select(*rows.columns, "_i.input", "_i.labels")


def dpo_reason(rows: DataFrame) -> DataFrame:
    """P1. ``rows`` with ``reason``, null if the row is fit: no_chosen, no_rejected or no_prompt."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    has = F.col("messages").isNotNull() if "messages" in rows.columns else F.lit(False)
    return rows.withColumn("reason", F.when(blank("chosen"), "no_chosen").when(blank("rejected"), "no_rejected").when(~has & blank("instruction"), "no_prompt"))


def dpo_side(prompt: Column, answer: Column, max_len: int) -> Column:
    """P2. struct(ids, mask) of a side: cut on the left to max_len; the mask, over shifted places, is 1 from the answer's
    first id on."""

    def side(both: Column) -> Column:
        p = F.greatest(F.lit(0), F.least(both["p"], F.size(both["ids"])) - 1)
        places = F.slice(both["ids"], F.lit(2), F.greatest(F.lit(0), F.size(both["ids"]) - 1))
        return F.struct(both["ids"].alias("ids"), let(p, lambda p: F.transform(places, lambda x, i: (i >= p).cast("float"))).alias("mask"))

    ids = F.struct(prompt.alias("p"), answer.alias("a"))
    return let(let(ids, lambda x: _cut(x["p"], F.concat(x["p"], x["a"]), max_len)), side)


def last_answer(messages: Column) -> Column:
    """P3. struct(context, target) if the last turn is an answer, else null."""
    last = F.element_at(messages, -1)
    return F.when(last["role"] == "assistant", F.struct(F.slice(messages, F.lit(1), F.size(messages) - 1).alias("context"), last["content"].alias("target")))


def dpo_pairs(rows: DataFrame, rejected: str) -> DataFrame:
    """P4, P5. (messages, chosen, rejected) with the context only as messages, so that no prompt holds its answer.
    ``rejected`` is the column that a generator filled."""
    turn = rows.withColumn("_t", last_answer(F.col("messages"))).where("_t is not null")
    return turn.select(*[c for c in rows.columns if c not in ("messages", rejected)], F.col("_t.context").alias("messages"), F.col("_t.target").alias("chosen"), F.col(rejected).alias("rejected")).where(F.col("chosen") != F.col("rejected"))


def expand_turns(user: Column, assistant: Column, follow: Column, max_turns: int) -> Column:
    """S6. One exchange and at most max_turns follow-ups, as messages."""
    more = F.flatten(F.transform(F.slice(follow, 1, max_turns), lambda f: F.array(message("user", f["user"]), message("assistant", f["assistant"]))))
    return F.concat(F.array(message("user", user), message("assistant", assistant)), more)


def long_form(rows: DataFrame, least: int = 150) -> DataFrame:
    """S7."""
    return rows.where(F.length("output") >= least)


def expand_templates(bases: DataFrame, templates: DataFrame, inserts: DataFrame | None = None, extras: DataFrame | None = None, n: int = 25, most: int = 28, seed: int = 42) -> DataFrame:
    """S8, D14. (instruction, variant) of ``bases`` (instruction, and output if the answer may stand in a template too). Each
    template (column template) with ``{q}`` for a base and ``{words}`` for an insert (column words, a comma after it): n of
    the distinct ones by draw. Then templates of ``extras`` (template, rank) in order, up to ``most``. No variant equals its
    base. All tables but ``bases`` are configuration of some dozen rows, which their count checks."""
    put = lambda t, q, w: F.replace(F.replace(t, F.lit("{q}"), q), F.lit("{words}"), w)
    for table in (templates, inserts, extras):
        if table is not None and table.count() > 10_000:
            raise ValueError("templates are configuration; this many are data")
    said = F.array(*[F.col(c) for c in ("instruction", "output") if c in bases.columns])
    words = F.when(F.col("words") != "", F.concat("words", F.lit("，"))).otherwise(F.lit(""))
    form = templates.crossJoin(F.broadcast(inserts.select("words"))) if inserts is not None else templates.withColumn("words", F.lit(""))
    met = bases.select("instruction", F.explode(said).alias("q")).crossJoin(F.broadcast(form)).select("instruction", put(F.col("template"), F.col("q"), words).alias("variant")).where("variant <> instruction")
    order = Window.partitionBy("instruction").orderBy(uniform(seed, F.col("variant")), "variant")
    drawn = met.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    if extras is None:
        return drawn
    more = bases.select("instruction").distinct().crossJoin(F.broadcast(extras.select("template", "rank"))).select("instruction", put(F.col("template"), F.col("instruction"), F.lit("")).alias("variant"), "rank").where("variant <> instruction")
    every = drawn.withColumn("rank", F.lit(-1)).unionByName(more.withColumn("rank", F.col("rank").cast("int"))).groupBy("instruction", "variant").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy("instruction").orderBy("rank", "variant")
    return every.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).select("instruction", "variant")


def distill(rows: DataFrame, ask: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """S9. Answers of a callable that stands for an outside model."""
    import pandas as pd

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(ask)

    return rows.withColumn("answer", answer(F.col(column)))
