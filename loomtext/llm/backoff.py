"""Stupid-backoff scores of all documents, as joins of n-grams with count tables that are partitioned by hash.

Each document is scored by the n-gram counts of all other documents: a document's own counts are taken off, so that a
text is not expected because it stands in the corpus itself. For a word and the longest context there is,

    S(w | context) = c(context w) / c(context)   if c(context w) > 0,   else   alpha * S(w | context without its first word)

down to c(w) / N, and 1 / N for a word that no other document has. A document's score is the sum of ln S.

The tables travel in blocks. ``blocks`` writes the texts as blocks of bounded size. Each block explodes into its distinct
n-grams of each order with their counts, as ascending hashes, cut by hash range into buckets (one row per block and
bucket, hashes as compressed deltas: a map-side combine). A bucket's task adds up the counts of each n-gram over all
blocks, which is its part of the count table, and joins them back to the n-grams of every block; the block's task puts its
buckets together, looks up each position and sums by document. A frequent n-gram is one entry per block, so no key is hot.
All documents count, whole; nothing is pruned.

Blocks and buckets both grow with the corpus, so a row for each pair would hold ever fewer n-grams. Where they would hold
less than ``LEAST_GRAMS``, in over ``MANY_ROWS`` rows, rows go by way of groups: a block is cut into coarse ranges only, the blocks of a group are added
up within a coarse range, and what comes out is cut into buckets; sums go back the same way. With the square root of the
blocks as groups and of the buckets as ranges, both hops have the square root of the rows. The result is the same.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case. Defined cases: null and empty texts have no words and score 0; with
a single document every word is new; equal texts with other rows count as other documents; a null doc_id is scored like
any other; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, hash_words, keep, mixed, odd_numbers, release, small_batches, split_words, tables

ORDER, ALPHA = 3, 0.4
#: Bits of an n-gram's hash: among 10**9 n-grams less than one pair is expected to meet. Each bit is an eighth of a byte
#: per n-gram in the shuffle.
HASH_BITS = 60
#: Text of a block, and n-grams that a bucket is to hold.
BLOCK_BYTES = 8 << 20
BUCKET_WORDS = 2 << 20
#: Rows go by way of groups of blocks if there would be more than this many, with fewer n-grams in each on average.
MANY_ROWS, LEAST_GRAMS = 1 << 20, 1000
#: Tasks of a shuffle, at most; a task takes its buckets one by one.
TASKS = 1 << 16


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as compressed byte planes, without planes that are empty."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return width.to_bytes(1) + len(x).to_bytes(8) + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """(block, n_words, texts): texts is an Arrow stream of (doc_id, text)."""
    small_batches(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, t in enumerate(tables(batches, limit=BLOCK_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            n = len(split_words(column(t, "text"))[0])
            yield pa.RecordBatch.from_arrays([pa.array([part + k]), pa.array([n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_words", "texts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over, "block long, n_words long, texts binary")


class Grams:
    """The n-grams of a block. ``at[k]``: hash of the (k + 1)-gram that ends at each word; 0 where the document begins
    later than it would."""

    def __init__(self, texts: bytes, order: int):
        t = pa.ipc.open_stream(texts).read_all().combine_chunks()
        self.doc_ids = column(t, "doc_id")
        codes, self.n, words = split_words(column(t, "text"), lower=True)
        w = hash_words(words)[codes] if len(words) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.index = np.arange(len(w)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        times = odd_numbers(order, 17)
        self.at = []
        total = np.zeros(len(w), np.uint64)
        for k in range(order):
            total[k:] += w[: len(w) - k] * times[k]
            self.at.append(np.where(self.index >= k, np.maximum(mixed(total + np.uint64(k + 1)) >> np.uint64(64 - HASH_BITS), np.uint64(1)), np.uint64(0)))

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct hashes, the entry of each word (or -1), counts."""
        real = np.flatnonzero(self.at[k])
        names, inverse, count = np.unique(self.at[k][real], return_inverse=True, return_counts=True)
        entry = np.full(len(self.at[k]), -1, np.int64)
        entry[real] = inverse
        return names, entry, count


def _texts(file: str, block: int) -> bytes:
    """A block's texts, read from the shared folder instead of sent through another shuffle. Each block is a row group."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        source = pq.ParquetFile(f)
        for g in range(source.num_row_groups):
            stats = source.metadata.row_group(g).column(0).statistics
            if stats is None or not stats.has_min_max or stats.min <= block <= stats.max:
                t = source.read_row_group(g, columns=["block", "texts"])
                at = t.column(0).to_pylist()
                if block in at:
                    return t.column(1)[at.index(block)].as_py()
    raise LookupError(f"block {block} is not in {file}")


def _cut(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[int, list[bytes]]]:
    """Ascending hashes and counts of each order by the upper ``bits`` of the hash: range, packed; empty ranges are left
    out."""
    at = [(names >> np.uint64(HASH_BITS - bits)).astype(np.int64) for names, _ in parts]
    first = [np.flatnonzero(np.diff(x, prepend=-1)) for x in at]
    edges = [dict(zip(x[f].tolist(), zip(f.tolist(), np.append(f[1:], len(x)).tolist(), strict=True), strict=True)) for x, f in zip(at, first, strict=True)]
    for j in sorted({j for e in edges for j in e}):
        spans = [e.get(j, (0, 0)) for e in edges]
        yield j, [x for (names, count), (a, z) in zip(parts, spans, strict=True) for x in (_pack(np.diff(names[a:z], prepend=np.uint64(0))), _pack(count[a:z]))]


def _added(held: list[list[bytes]], order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[list[np.ndarray]]]:
    """The n-grams of some packed rows added up, by order: (hashes, counts); and for each row where its own are in them."""
    every, places = [], [[] for _ in held]
    for k in range(order):
        each = [np.cumsum(_unpack(g[2 * k]), dtype=np.uint64) for g in held]
        flat, n = np.concatenate(each), np.array(list(map(len, each)))
        counts = np.concatenate([_unpack(g[2 * k + 1]) for g in held])
        turn = np.argsort(flat, kind="stable")
        sorted_ = flat[turn]
        new = np.ones(len(flat), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        first = np.flatnonzero(new)
        every.append((sorted_[first], np.add.reduceat(counts[turn], first) if len(first) else counts))
        place = np.empty(len(flat), np.int64)
        place[turn] = np.cumsum(new) - 1
        z = np.cumsum(n)
        for own, a, e in zip(places, (z - n).tolist(), z.tolist(), strict=True):
            own.append(place[a:e])
    return every, places


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, n_backed_off, score) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    kept = keep(blocks(docs), "lm-blocks", **{"parquet.block.row.count.limit": "1"})
    n_blocks, total = (int(x) for x in kept.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first())
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (max(shuffle, total * order // BUCKET_WORDS) - 1).bit_length())
    n_rows = n_blocks << bits
    grouped = n_rows > MANY_ROWS and total * order < LEAST_GRAMS * n_rows
    tasks = max(shuffle, min(1 << bits, TASKS))
    coarse = (bits + 1) // 2 if grouped else bits
    groups = max(1, round(n_blocks**0.5))
    schema = "block long, bucket int, grams array<binary>, file string"
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("grams", pa.list_(pa.binary())), ("file", pa.string())])

    def rows(some: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        while held := list(islice(some, 64)):
            block, bucket, grams = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(grams, pa.list_(pa.binary())), pa.nulls(len(held), pa.string())], schema=kinds)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, texts in zip(b.column("block").to_pylist(), b.column("texts").to_pylist(), strict=True):
                g = Grams(texts, order)
                yield from rows((block, j, grams) for j, grams in _cut([g.distinct(k)[::2] for k in range(order)], coarse))

    def by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
        """Rows that come by ``keys``, those of each key together."""
        every = (r for b in batches for r in b.to_pylist())
        return ((key, list(own)) for key, own in groupby(every, lambda r: tuple(r[k] for k in keys)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket: the sums of their n-grams, for every block (or group) that has them."""
        for (bucket,), held in by(batches, "bucket"):
            every, places = _added([r["grams"] for r in held], order)
            yield from rows((r["block"], bucket, [_pack(every[k][1][own[k]]) for k in range(order)]) for r, own in zip(held, places, strict=True))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group and coarse range: the group's sums, by bucket."""
        for (group, _), held in by(batches, "group", "bucket"):
            every, _ = _added([r["grams"] for r in held], order)
            yield from rows((group, j, grams) for j, grams in _cut(every, bits))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group and coarse range, those of blocks first: the sums that came back for the group, for each block."""
        for (_, coarse_range), held in by(batches, "group", "range"):
            own = [r for r in held if r["bucket"] < 0]
            back = [r["grams"] for r in held if r["bucket"] >= 0]
            sums = [np.concatenate([_unpack(g[k]) for g in back]) for k in range(order)]
            _, places = _added([r["grams"] for r in own], order)
            yield from rows((r["block"], coarse_range, [_pack(sums[k][at[k]]) for k in range(order)]) for r, at in zip(own, places, strict=True))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: the file that has its texts first, its buckets in ascending order."""
        at, grams = None, []

        def score() -> Iterator[pa.RecordBatch]:
            g = Grams(_texts(*at), order)
            counts = []
            for k in range(order):
                names, entry, _ = g.distinct(k)
                everywhere = np.concatenate([_unpack(x[k]) for x in grams] or [np.zeros(0, np.uint64)]).astype(np.int64)
                own_key = g.doc * (len(names) + 1) + entry + 1
                _, back, own = np.unique(own_key, return_inverse=True, return_counts=True)
                here = entry >= 0
                c = np.zeros(len(entry), np.int64)
                c[here] = everywhere[entry[here]] - own[back[here]]
                counts.append(c)
            rest = np.maximum(total - np.repeat(g.n, g.n), 1).astype(float)
            ln, done = np.zeros(len(rest)), np.zeros(len(rest), bool)
            level = np.minimum(order, g.index + 1)
            backed = np.zeros(len(rest), bool)
            for k in range(order, 0, -1):
                now = ~done & (level >= k) & (counts[k - 1] > 0)
                top = counts[k - 1][now].astype(float)
                below = counts[k - 2][np.flatnonzero(now) - 1].astype(float) if k > 1 else rest[now]
                ln[now] = np.log(top / below) + (level[now] - k) * np.log(alpha)
                backed |= now & (level > k)
                done |= now
            ln[~done] = np.log(1 / rest[~done]) + level[~done] * np.log(alpha)
            backed |= ~done
            summed = np.bincount(g.doc, weights=ln, minlength=len(g.n))
            short = np.bincount(g.doc, weights=backed, minlength=len(g.n)).astype(np.int64)
            rows = pa.table([g.doc_ids, pa.array(g.n.astype(np.int64)), pa.array(short), pa.array(summed)], ["doc_id", "n_words", "n_backed_off", "score"])
            yield from rows.to_batches(max_chunksize=4096)

        for b in batches:
            for block, file, g in zip(b.column("block").to_pylist(), b.column("file").to_pylist(), b.column("grams").to_pylist(), strict=True):
                if file is not None:
                    if at is not None:
                        yield from score()
                    at, grams = (file, block), []
                else:
                    grams.append(g)
        if at is not None:
            yield from score()

    dealt = lambda df, n, keys, order_: df.repartition(n, *keys).sortWithinPartitions(*keys, *order_)
    exploded = kept.mapInArrow(explode, schema)
    if grouped:
        exploded = keep(exploded.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))), "lm-grams")
        met = dealt(exploded, tasks, ["group", "bucket"], ["block"]).mapInArrow(up, schema)
        sums = dealt(met, tasks, ["bucket"], ["block"]).mapInArrow(count, schema)
        back = sums.select(F.col("block").alias("group"), F.shiftright("bucket", bits - coarse).alias("range"), F.lit(-1).cast("long").alias("block"), "bucket", "grams")
        own = exploded.select("group", F.col("bucket").alias("range"), "block", F.lit(-1).alias("bucket"), "grams")
        counted = dealt(own.unionByName(back), tasks, ["group", "range"], ["bucket", "block"]).mapInArrow(down, schema)
    else:
        counted = dealt(exploded, tasks, ["bucket"], ["block"]).mapInArrow(count, schema)
    whole = kept.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("array<binary>").alias("grams"), F.input_file_name().alias("file"))
    met = whole.unionAll(counted).repartition(max(shuffle, min(n_blocks // 8, TASKS)), "block").sortWithinPartitions("block", "bucket")
    out = keep(met.mapInArrow(sum_up, "doc_id long, n_words long, n_backed_off long, score double"), "lm-scores")
    release(spark, kept, *([exploded] if grouped else []))
    return out
