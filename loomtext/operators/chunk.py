"""Chunking and windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import regexes as R
from loomtext.functions.text import uniform
from loomtext.plans.session import checkpointed

_SENTENCE = re.compile(R.SENTENCE)


def sentences(text: Column) -> Column:
    """T1. Runs of text and runs of sentence ends, in turn."""
    return F.regexp_extract_all(text, F.lit(R.SENTENCE), F.lit(0))


def pack(text: Column, max_len: int = 400) -> Column:
    """T2. Sentences packed into chunks of at most max_len characters; longer pieces are cut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, piece: Column) -> Column:
        full = (F.length(a["buf"]) + F.length(piece) > max_len) & (a["buf"] != "")
        out = F.when(full, F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])
        buf = F.when(full, F.lit("")).otherwise(a["buf"])
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / max_len)), lambda k: F.substring(piece, (k * max_len + 1).cast("int"), F.lit(max_len)))
        long = F.length(piece) > max_len
        return F.struct(F.when(long, F.concat(out, cuts)).otherwise(out).alias("out"), F.when(long, F.lit("")).otherwise(F.concat(buf, piece)).alias("buf"))

    return F.aggregate(sentences(text), start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))


def pack_stream(lines: DataFrame, order: str, max_len: int = 400, group: str | None = None) -> DataFrame:
    """T3. Packing that goes on from line to line: lines (text, ``order``, which tells them apart) lose their outer white
    space and are cut into sentences one by one, a blank line flushes the chunk and is written itself; ``group`` keeps
    sources apart. A row per chunk: (group, order and sentence number where it begins, slice of a longer sentence, chunk).

    Where a chunk ends depends on all lines before it, yet no task sees more than a range of them: all that a range needs of
    the ones before is how full the chunk is. (1) Each range tells what it makes of every fullness, a table of max_len + 1
    numbers; (2) these are chained in order, a short row per range; (3) each range is packed from its own fullness; (4) the
    chunks that go over from range to range are put together, two short texts per range."""
    g = group or "_g"
    rows = lines if group else lines.withColumn("_g", F.lit(""))
    rows = rows.select(F.col(g).cast("string").alias("_g"), F.col(order).alias("_o"), "text")
    dealt = checkpointed(rows.repartitionByRange("_g", "_o").withColumn("_p", F.spark_partition_id()), "lines")
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = lambda df, *by: df.repartition(parts, *by[:1]).sortWithinPartitions(*by)
    kind = rows.schema["_o"].dataType.simpleString()

    effects = in_order(dealt, "_p", "_g", "_o").mapInArrow(lambda b: _effects(b, max_len), "_g string, _p int, ends array<int>")
    starts = in_order(effects, "_g", "_p").mapInArrow(_chained, "_g string, _p int, _full int")
    known = dealt.join(starts, dealt["_g"].eqNullSafe(starts["_g"]) & (dealt["_p"] == starts["_p"])).select(dealt["*"], "_full")
    schema = f"_g string, _p int, _o {kind}, piece int, slice int, chunk string, head string, flushed boolean"
    packed = checkpointed(in_order(known, "_p", "_g", "_o").mapInArrow(lambda b: _packed(b, max_len), schema), "chunks")
    over = in_order(packed.where("head is not null"), "_g", "_p").mapInArrow(_seams, f"_g string, _o {kind}, piece int, slice int, chunk string")
    out = packed.where("head is null").select("_g", "_o", "piece", "slice", "chunk").unionAll(over)
    return out.select(*([F.col("_g").alias(group)] if group else []), F.col("_o").alias(order), "piece", "slice", "chunk")


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come in the order of ``keys``, by their values."""
    return groupby((r for b in batches for r in b.to_pylist()), lambda r: tuple(r[k] for k in keys))


def _effects(batches: Iterator[pa.RecordBatch], max_len: int) -> Iterator[pa.RecordBatch]:
    """For each range and group: how full the chunk is after it, by how full it was before."""
    for (part, group), rows in _groups(batches, "_p", "_g"):
        now, of = np.arange(max_len + 1), np.arange(max_len + 1)
        for r in rows:
            line = (r["text"] or "").strip()
            for n in map(len, _SENTENCE.findall(line)) if line else [max_len + 1]:
                now = np.zeros_like(now) if n > max_len else np.where((now > 0) & (now + n > max_len), n, now + n)
                if len(now) > 1:  # what was different becomes equal soon
                    now, same = np.unique(now, return_inverse=True)
                    of = same[of]
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([part], pa.int32()), pa.array([now[of].tolist()], pa.list_(pa.int32()))], ["_g", "_p", "ends"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How full the chunk is at the start of each range of a group."""
    for (group,), rows in _groups(batches, "_g"):
        full = 0
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([r["_p"]], pa.int32()), pa.array([full], pa.int32())], ["_g", "_p", "_full"])
            full = r["ends"][full]


def _packed(batches: Iterator[pa.RecordBatch], max_len: int) -> Iterator[pa.RecordBatch]:
    """The chunks that lie in a range, with a null head; and for each range a row with what it adds to the chunk that comes
    into it (head), whether that ends there, and the chunk that goes out of it."""
    first = next(batches, None)
    if first is None:
        return
    names = ["_g", "_p", "_o", "piece", "slice", "chunk", "head", "flushed"]
    kinds = [pa.string(), pa.int32(), first.schema.field("_o").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def made() -> Iterator[tuple]:
        for (part, group), rows in _groups(chain([first], batches), "_p", "_g"):
            head, held, size, at, here = "", [], None, None, True  # here: the chunk came into this range

            def flush(to: list) -> None:
                nonlocal head, held, size, here
                if here:
                    head = "".join(held)
                elif held:
                    to.append((group, part, *at, 0, "".join(held), None, None))
                held, size, here = [], 0, False

            for r in rows:
                if size is None:
                    size = r["_full"]
                    here = size > 0
                out: list[tuple] = []
                line = (r["text"] or "").strip()
                if not line:
                    flush(out)
                    out.append((group, part, r["_o"], 0, 0, "", None, None))
                for k, s in enumerate(_SENTENCE.findall(line)):
                    if size and size + len(s) > max_len:
                        flush(out)
                    if len(s) > max_len:
                        out += [(group, part, r["_o"], k, i // max_len, s[i : i + max_len], None, None) for i in range(0, len(s), max_len)]
                        continue
                    at = at if held or here else (r["_o"], k)
                    held.append(s)
                    size += len(s)
                yield from out
            tail = "" if here else "".join(held)
            yield (group, part, *(at if tail else (None, 0)), 0, tail, "".join(held) if here else head, not here)

    rows = made()
    while some := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that go over from range to range."""
    first = next(batches, None)
    if first is None:
        return
    kinds = [pa.string(), first.schema.field("_o").type, pa.int32(), pa.int32(), pa.string()]
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], ["_g", "_o", "piece", "slice", "chunk"])
    for (group,), rows in _groups(chain([first], batches), "_g"):
        held, at = "", None
        for r in rows:
            held += r["head"]
            if r["flushed"]:
                if held:
                    yield row(group, *at, 0, held)
                held, at = r["chunk"], (r["_o"], r["piece"])
        if held:
            yield row(group, *at, 0, held)


def windows(ids: Column, length: int, stride: int | None = None) -> Column:
    """T4. ids[i * stride : i * stride + length + 1]; what is left at the end is dropped."""
    stride = stride or 3 * length // 4
    n = F.when(F.size(ids) < length + 1, 0).otherwise(F.floor((F.size(ids) - length - 1) / stride) + 1).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(ids, i * stride + 1, length + 1))


def random_cut(ids: Column, key: Column, share: float = 0.1, seed: int = 42) -> Column:
    """T5. With probability ``share`` cut to a length between half and all."""
    n = F.size(ids)
    length = (F.floor(n / 2) + F.floor(uniform(seed + 1, key) * (n - F.floor(n / 2) + 1))).cast("int")
    return F.when(uniform(seed, key) < share, F.slice(ids, 1, F.least(n, length))).otherwise(ids)


def pad(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(ids)).cast("int")))


def collate(rows: DataFrame, batch: str, ids: str = "ids", value: int = 0) -> DataFrame:
    """T7. Rows padded to the longest of their batch, as ``input`` (without the last id) and ``target`` (the first)."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    full = rows.join(longest, batch).withColumn("_ids", pad(F.col(ids), F.col("_n"), value))
    return full.select(*rows.columns, F.slice("_ids", F.lit(1), F.col("_n") - 1).alias("input"), F.slice("_ids", F.lit(2), F.col("_n") - 1).alias("target"))


def collate_pairs(rows: DataFrame, batch: str, value: int = 0) -> DataFrame:
    """T8. Chosen and rejected ids and masks, each padded to its own longest; masks are one shorter."""
    longest = rows.groupBy(batch).agg(F.max(F.size("chosen")).alias("_c"), F.max(F.size("rejected")).alias("_r"))
    met = rows.join(longest, batch)
    zero = lambda m, n: F.concat(m, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), n - 1 - F.size(m)).cast("int")))
    return met.select(*[c for c in rows.columns if c not in ("chosen", "rejected", "chosen_mask", "rejected_mask")], pad(F.col("chosen"), F.col("_c"), value).alias("chosen"), pad(F.col("rejected"), F.col("_r"), value).alias("rejected"), zero(F.col("chosen_mask"), F.col("_c")).alias("chosen_mask"), zero(F.col("rejected_mask"), F.col("_r")).alias("rejected_mask"))
