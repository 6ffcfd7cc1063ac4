"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``n`` words (all words as one shingle if it has fewer). The steps:

1. ``signatures``: one pass over the texts gives each document the digest of its set, ``bands * rows`` minima hashed to
   one key per band, and the low ``bits`` bits of every minimum packed into a signature.
2. Documents with equal sets fall together (by digest, with a partial aggregation, so thousands of copies are one node).
3. Band candidates: nodes with the same key in a band are linked to the smallest of them, one row per node and band,
   never all pairs. The components of these links are clusters: every pair that shares a band is inside one.
4. ``resolve``: inside a cluster, similarity is estimated from the packed signatures by bit counts, corrected for chance
   collisions (a share 2**-bits of unequal minima agree); pairs whose estimate is ``slack`` standard errors or more below
   the threshold are passed over, the others are confirmed on the full sets. A walk over the cluster from node to node
   finds its true components without listing its pairs. A cluster of more than ``BLOCK_SHINGLES`` shingles is dealt
   into blocks; every pair of blocks is walked on its own, and gives back a spanning forest only. With so many blocks that
   this would copy a text more often than it has bands, each of the cluster's band groups is walked instead, and only one
   that is itself that large is dealt into blocks: chains of weak candidates make large clusters, but share no band.
5. The components of all confirmed links, and each document's smallest member.

The number of bands follows from the threshold: with 26 bands of 5 rows, two documents at similarity 0.85 miss every band
with probability 2.4e-7, with 39 bands two at 0.80 with 1.9e-7, and at 6.5 standard errors the estimate passes over one with 4e-11. Shingles are compared as 64-bit hashes of 64-bit word hashes: two documents of 10**4
words hold two different shingles as equal with probability 5e-12, and each changes a similarity by 1e-4. Sets are told
apart by 120 bits, so that two of 10**10 different ones meet with probability 4e-17.

Defined cases: null, empty or blank texts have the empty set, and are linked with nothing; equal texts are linked
whatever their doc_id; a repeated doc_id keeps one row per row; a component whose doc_ids are all null has a null id and
keeps all rows; an empty table gives an empty result. Extra columns are ignored by ``components_of`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, free_name, hash_words, keep, mixed, odd_numbers, ragged, release, small_batches, split_words, tables

ROWS, BITS, SLACK = 5, 2, 6.5
#: Probability at most that two documents at the threshold share no band.
MISS = 2.5e-7
#: Shingles that one task holds of a cluster.
BLOCK_SHINGLES = 1 << 20


def bands_for(percent: int, rows: int) -> int:
    """The bands that two documents at the threshold all miss with probability ``MISS`` at most."""
    return 1 if percent >= 100 else ceil(log(MISS) / log1p(-((percent / 100) ** rows)))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and their number."""
    codes, count, words = split_words(texts, lower=True)
    w = hash_words(words)[codes] if len(words) else np.zeros(0, np.uint64)
    k = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.cumsum(count) - count
    at = ragged(first, k)
    short = np.repeat((count < n) * count, k)  # words of a text with fewer than n, else 0
    times = odd_numbers(n, 5)
    h = short.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([w, np.zeros(n, np.uint64)])
    for j in range(n):
        h += np.where((short == 0) | (j < short), padded[at + j], np.uint64(0)) * times[j]
    h = mixed(h)
    own = np.repeat(np.arange(len(k)), k)
    order = np.lexsort((h, own))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.bincount(own[new], minlength=len(k))


def minima(sets: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """k minima of each set under k hash functions, all ones for an empty set."""
    a = (odd_numbers(k, 7) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    b = (odd_numbers(k, 11) >> np.uint64(32)).astype(np.uint32)
    s = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(n), k), 0xFFFFFFFF, np.uint32)
    end = np.cumsum(n)
    for i, (z, c) in enumerate(zip(end.tolist(), n.tolist(), strict=True)):
        for at in range(z - c, z, 1024):
            h = s[at : min(z, at + 1024), None] * a
            h += b
            np.minimum(out[i], h.min(0), out=out[i])
    return out


def _sketch(low: np.ndarray, bands: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the low bits of the minima packed into 64-bit words."""
    m = mixed(low.astype(np.uint64) + np.uint64(0x100000000) * np.arange(low.shape[1], dtype=np.uint64))
    keys = mixed((m.reshape(len(m), bands, rows) * odd_numbers(rows, 13)).sum(2) + np.arange(bands, dtype=np.uint64))
    per = 64 // bits
    short = m & np.uint64((1 << bits) - 1)
    short = np.concatenate([short, np.zeros((len(m), -m.shape[1] % per), np.uint64)], 1).reshape(len(m), -1, per)
    return keys, (short << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(2, dtype=np.uint64)


#: Nodes are numbers of 120 bits, as decimals, which Spark aggregates by hash.
NODE, ARROW_NODE = "decimal(38,0)", pa.decimal128(38, 0)


def node_of(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=15).digest(), "little")


def signatures(docs: DataFrame, n: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(doc_id, n_shingles, node, bands, signature, version); node, the set's digest, is null for an empty set."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches, limit=4 << 20):
            sets, k = shingles(column(t, "text"), n)
            keys, packed = _sketch(minima(sets, k, bands * rows), bands, rows, bits)
            z = np.cumsum(k)
            node = pa.array([Decimal(node_of(sets[e - c : e])) if c else None for e, c in zip(z.tolist(), k.tolist(), strict=True)], ARROW_NODE)
            lists = pa.ListArray.from_arrays(np.arange(len(k) + 1, dtype=np.int32) * bands, keys.view(np.int64).ravel())
            rows_ = pa.table([column(t, "doc_id"), pa.array(k.astype(np.int64)), node, lists, pa.array([x.tobytes() for x in packed], pa.binary()), column(t, "version")], ["doc_id", "n_shingles", "node", "bands", "signature", "version"])
            yield from rows_.to_batches(max_chunksize=4096)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version")).mapInArrow(sign, f"doc_id long, n_shingles long, node {NODE}, bands array<long>, signature binary, version long")


def estimate(one: np.ndarray, others: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Collision-corrected similarity of one packed signature with others: the share of k minima whose low bits agree,
    less the share 2**-bits of unequal minima that agree by chance."""
    x = one ^ others
    odd = x
    for j in range(1, bits):
        odd = odd | (x >> np.uint64(j))
    mask = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    differ = np.bitwise_count(odd & mask).sum(1)
    chance = 2.0**-bits
    return ((k - differ) / k - chance) / (1 - chance)


def walk(sets: list[np.ndarray], packed: np.ndarray, percent: int, k: int, bits: int, slack: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among these sets, as index pairs."""
    chance = 2.0**-bits
    p = percent / 100 + (1 - percent / 100) * chance
    least = percent / 100 - slack * (p * (1 - p) / k) ** 0.5 / (1 - chance)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(n) - n
    mark = np.zeros(len(names), np.uint8)
    left = np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            maybe = left[(n[left] * 100 >= percent * n[x]) & (n[x] * 100 >= percent * n[left])]
            maybe = maybe[estimate(packed[x], packed[maybe], k, bits) >= least]
            if not len(maybe):
                continue
            own = flat[at[x] : at[x] + n[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[flat[ragged(at[maybe], n[maybe])]], np.cumsum(n[maybe]) - n[maybe], dtype=np.int64)
            mark[own] = 0
            linked = maybe[shared * 100 >= percent * (n[x] + n[maybe] - shared)]
            if len(linked):
                yield from ((x, int(y)) for y in linked)
                queue += linked.tolist()
                left = left[~np.isin(left, linked)]


def resolve(cluster: DataFrame, percent: int, n: int, bits: int, k: int, slack: float) -> DataFrame:
    """Links (a, b) that span the components of each (cid, i, j, node, signature, text) group; i, j is a pair of blocks."""
    kinds = pa.schema([("a", ARROW_NODE), ("b", ARROW_NODE)])

    def linked(nodes: list, packed: list, sets: list) -> pa.RecordBatch:
        found = [(nodes[x], nodes[y]) for x, y in walk(sets, np.stack(packed), percent, k, bits, slack)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], ARROW_NODE), pa.array([x[1] for x in found], ARROW_NODE)], schema=kinds)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, packed, sets = None, [], [], []
        for t in tables(batches, limit=4 << 20):
            got, count = shingles(column(t, "text"), n)
            z = np.cumsum(count)
            keys = zip(*(t.column(c).to_pylist() for c in ("cid", "i", "j")), strict=True)
            for own_key, e, c, node, raw in zip(keys, z.tolist(), count.tolist(), t.column("node").to_pylist(), t.column("signature").to_pylist(), strict=True):
                if own_key != key:
                    if sets:
                        yield linked(nodes, packed, sets)
                    key, nodes, packed, sets = own_key, [], [], []
                own = got[e - c : e]
                if node_of(own) == node:  # else a row with the same doc_id
                    nodes.append(node)
                    packed.append(np.frombuffer(raw, np.uint64))
                    sets.append(own.copy())
        if sets:
            yield linked(nodes, packed, sets)

    parts = int(cluster.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cluster.repartition(parts, "cid", "i", "j").sortWithinPartitions("cid", "i", "j").mapInArrow(over, f"a {NODE}, b {NODE}")


def components_of(docs: DataFrame, percent: int = 85, n: int = 5, bands: int | None = None, rows: int = ROWS, bits: int = BITS, slack: float = SLACK, version: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text), and ``version``, a hash of its text,
    if asked for."""
    more = ["version"] * version
    spark = docs.sparkSession
    bands = bands or bands_for(percent, rows)
    signed = keep(signatures(docs, n, bands, rows, bits), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    least = keyed.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keyed.join(least, ["band", "key"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = components(stars)
    members = clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = keep(members.join(nodes.select("node", "doc_id", "signature", "n_shingles"), "node").select("node", F.col("root").alias("cid"), "doc_id", "signature", "n_shingles"), "members")
    blocks = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")
    sized = members.join(members.groupBy(F.col("cid").alias("whole")).agg(blocks), F.col("cid") == F.col("whole")).drop("whole")
    groups = sized.where(F.col("blocks") <= bands + 1).withColumn("cid", F.xxhash64("cid"))
    large = sized.where(F.col("blocks") > bands + 1).drop("blocks").join(keyed, "node").withColumn("cid", F.xxhash64("cid", "band", "key")).drop("band", "key")
    groups = groups.unionByName(large.join(large.groupBy(F.col("cid").alias("whole")).agg(blocks, F.count("*").alias("n")).where("n > 1").drop("n"), F.col("cid") == F.col("whole")).drop("whole"))
    # block b of a group goes to the tasks (b, j) and (i, b): every pair of blocks meets once, and each block itself when it is alone
    placed = groups.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, blocks - 1), x -> x <> block)"))
    dealt = placed.withColumn("other", F.explode(other)).select("cid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "signature", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), "text")
    cluster = dealt.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id"))).select("cid", "i", "j", "node", "signature", "text")
    links = components(resolve(cluster, percent, n, bits, bands * rows, slack))
    both = links.unionAll(links.select(F.col("root").alias("node"), "root").distinct())
    firsts = both.join(members.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = both.join(firsts, "root").select("node", "component_id")
    # a node outside of every component has its own smallest doc_id
    own = nodes.select("node", F.col("doc_id").alias("own_id")).join(named, "node", "left").select("node", F.coalesce("component_id", "own_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "node", *more).join(own, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    out = keep(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), *more), "components")
    release(spark, signed, members)
    return out


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each component, told by doc_id and a hash of the text. Of rows
    equal in both one stays."""
    own, version = free_name(docs, "kept_id"), free_name(docs, "kept_version")
    judged = components_of(docs, version=True, **options).where("kept")
    stays = judged.groupBy(F.col("doc_id").alias(own), F.col("version").alias(version)).agg(F.count("*").alias("n"))
    same = lambda k: docs["doc_id"].cast("long").eqNullSafe(k[own]) & (F.xxhash64(docs["text"]) == k[version])
    single, several = stays.where("n = 1"), stays.where("n > 1")
    out = docs.join(single, same(single), "left_semi")
    if several.isEmpty():
        return out
    return out.unionAll(docs.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "text"]))
