"""Numbers over arrays and schedules, Column to Column."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(x: Column) -> Column:
    """``x``, kept out of filters that are pushed below it: these would compute it, and all that it reads, again. The task's
    number, which is never negative, is no constant for the optimizer."""
    return F.when(F.spark_partition_id() >= 0, x)


def lr_cosine(step: Column, total: int, warmup: float = 0.01, least: float = 0.1) -> Column:
    """N1. Linear warm-up, then a cosine down to ``least``."""
    warm = max(1, int(total * warmup))
    progress = (step - warm) / max(1, total - warm)
    return F.when(step < warm, step / warm).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(pi) * F.least(F.lit(1.0), progress))))


def lr_wsd(step: Column, total: int, warmup: float = 0.02, stable: float = 0.8, least: float = 0.05) -> Column:
    """N2. Warm-up, a stable stretch, a cosine decay."""
    warm, flat = max(1, int(total * warmup)), int(total * stable)
    progress = (step - warm - flat) / max(1, total - warm - flat)
    return F.when(step < warm, step / warm).when(step < warm + flat, F.lit(1.0)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(pi) * F.least(F.lit(1.0), progress))))


def log_softmax(logits: Column) -> Column:
    """Log-probabilities of an array of logits."""
    total = lambda l, top: F.ln(F.aggregate(l, F.lit(0.0), lambda a, x: a + F.exp(x - top)))  # noqa: E731, E741
    return let(logits, lambda l: let(F.array_max(l), lambda top: let(total(l, top), lambda z: F.transform(l, lambda x: x - top - z))))  # noqa: E741


def masked_log_prob(logits: Column, ids: Column, mask: Column) -> Column:
    """N3. Sum over steps of mask * log-probability of the id."""
    steps = F.arrays_zip(logits.alias("l"), ids.alias("i"), mask.alias("m"))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["m"] * F.get(log_softmax(s["l"]), s["i"]))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """N4, of one pair: -ln sigmoid(beta * ((chosen - ref) - (rejected - ref)))."""
    x = -beta * ((chosen - ref_chosen) - (rejected - ref_rejected))
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def repetition_penalty(logits: Column, history: Column, penalty: float, window: int = 50) -> Column:
    """N5. Logits of ids among the last ``window``: negative ones times, others over the penalty."""
    last = F.slice(history, F.greatest(F.lit(1), F.size(history) - window + 1), window)
    return let(last, lambda recent: F.transform(logits, lambda x, i: F.when(F.array_contains(recent, i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x)))


def temperature(logits: Column, t: float) -> Column:
    """N5. Logits over t; unchanged at 0."""
    return F.transform(logits, lambda x: x / t) if t > 0 else logits


def top_k(logits: Column, k: int) -> Column:
    """N5. Null below the k-th largest logit; equals of it stay."""
    least = lambda l: F.get(F.array_sort(l), F.greatest(F.lit(0), F.size(l) - k))  # noqa: E731, E741
    return let(logits, lambda l: let(least(l), lambda low: F.transform(l, lambda x: F.when(x >= low, x))))  # noqa: E741


def top_p(logits: Column, p: float) -> Column:
    """N5. Null outside of the most likely ids whose mass reaches p; the one that crosses it stays. Equal logits are
    ranked by id."""
    logs = lambda l: F.transform(log_softmax(F.transform(l, lambda x: F.coalesce(x, F.lit(-1e30)))), lambda x, i: F.struct((-x).alias("l"), i.alias("i")))  # noqa: E731, E741

    def keep(acc: Column, x: Column) -> Column:
        go = acc["mass"] <= p
        return F.struct((acc["mass"] + F.exp(-x["l"])).alias("mass"), F.when(go, F.concat(acc["ids"], F.array(x["i"]))).otherwise(acc["ids"]).alias("ids"))

    kept = lambda l: F.aggregate(F.array_sort(logs(l)), F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("ids")), keep, lambda a: a["ids"])  # noqa: E731, E741
    return let(logits, lambda l: let(kept(l), lambda ids: F.transform(l, lambda x, i: F.when(F.array_contains(ids, i), x))))  # noqa: E741


def draw(logits: Column, u: Column) -> Column:
    """N5. The id that the uniform number u picks by the probabilities of the logits that are not null."""
    probs = F.transform(log_softmax(F.transform(logits, lambda x: F.coalesce(x, F.lit(-1e30)))), lambda x: F.exp(x))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["mass"] + x).alias("mass"), (a["n"] + (a["mass"] + x <= u).cast("int")).alias("n"))
    return F.least(F.aggregate(probs, start, step, lambda a: a["n"]), F.size(logits) - 1)


def z_loss(logits: Column, weight: float) -> Column:
    """N6. weight * mean over steps of the squared log-sum-exp."""
    lse = F.transform(logits, lambda s: let(F.array_max(s), lambda top: top + F.ln(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))
    return weight * F.aggregate(lse, F.lit(0.0), lambda a, x: a + x * x) / F.size(logits)
