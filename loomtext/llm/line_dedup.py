"""Line dedup by pairwise alignment.

1. ``fingerprints``: each document becomes the list of 64-bit hashes of its lines that hold a word (white space at the
   ends ignored), with their lengths.
2. Documents with equal lists of lines need one alignment: all but the earliest go as a whole (if they have ``min_chars``
   characters), and only the earliest is a partner of others.
3. Overlapping documents: any block of ``min_chars`` characters or more is made of runs, the shortest ranges of adjacent
   lines from each line on, or up to it, that have so many characters. The holders of a run are numbered by doc_id; a
   document is aligned with the first ``rare`` holders of its runs, and as long as a run of it is not wholly deleted, with
   the next ones, eight times as many in each round, until its earlier holders are all tried. The outcome is that of
   aligning every pair of documents that share a line: a line of a block is inside a run of that block, which is deleted
   already or leads to this partner.
4. ``align`` runs a patience diff over each pair: lines unique to both sides, in their longest increasing order, anchor
   the alignment; between anchors it recurses; runs of equal lines extend from both ends of every gap.
5. A common block is a run of aligned lines that are neighbours on both sides. Blocks of ``min_chars`` characters or more
   are deleted from the later document. Blocks are judged on the input, so the outcome doesn't depend on any order.

The earlier document is the one with the smaller doc_id. Defined cases: a null text stays null and an empty one empty;
rows with a null doc_id take no part and stay as they are; rows that share a doc_id don't align with each other, and
each is aligned with the earlier documents by its own text; lines repeated inside one
document are no concern of this operator; of several alignments that patience diff could choose from, ties go to the last
place on the later side; a text of any length is one list of hashes; an empty table gives an empty result. Extra columns
pass through, whatever their names, but for one named as the result, which gives way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.numeric import let

from .common import column, forget, free_name, hash_words, keep, mixed, small_batches, tables

#: Holders of a run that the first round aligns a document with.
RARE = 3
#: Pairs of a round up to which the documents in them are picked by a broadcast of their ids.
FEW = 20_000
#: Characters that a deleted block has, at least.
MIN_CHARS = 40
BLANK = " \t\n\x0b\f\r"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines, sizes, places): hashes, lengths in characters and line numbers of the lines that hold a
    word; version is a hash of the text."""
    small_batches(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            lists = pc.split_pattern(pc.fill_null(column(t, "text"), ""), "\n")
            coded = pc.ascii_trim(lists.flatten(), BLANK).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int32)
            full = size[codes] > 0
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            edges = np.concatenate([[0], np.cumsum(full)])[first].astype(np.int32)
            h = hash_words(coded.dictionary.cast(pa.binary())).view(np.int64)[codes][full]
            at = (np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))).astype(np.int32)[full]
            each = (pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (h, size[codes][full], at))
            yield from pa.table([column(t, "doc_id"), column(t, "version"), *each], ["doc_id", "version", "lines", "sizes", "places"]).to_batches(max_chunksize=4096)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version")).where("doc_id is not null and text is not null")
    return known.mapInArrow(over, "doc_id long, version long, lines array<long>, sizes array<int>, places array<int>")


def runs(prints: DataFrame, min_chars: int) -> DataFrame:
    """(run, doc_id, version, first, last, n): hash, first and last line number and number of lines of every shortest range
    of adjacent lines with ``min_chars`` characters, from a line on or up to it."""
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists = t.column("lines")
            h, size, place = (t.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lines", "sizes", "places"))
            edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            own = np.repeat(np.arange(len(lists)), np.diff(edges))
            upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            k = np.arange(len(h))
            to = np.maximum(np.searchsorted(upto, upto[:-1] + min_chars), k + 1)  # ranges from each line on
            since = np.minimum(np.searchsorted(upto, upto[1:] - min_chars, "right") - 1, k)  # and up to each
            begin, end = np.concatenate([k, since]), np.concatenate([to, k + 1])
            doc = np.concatenate([own, own])
            fit = (begin >= edges[doc]) & (end <= edges[doc + 1])
            begin, end = np.unique(np.stack([begin[fit], end[fit]]), axis=1)
            powers = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), x, np.uint64))])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h.view(np.uint64) * powers(base)[:-1])])
            run = mixed((sums[end] - sums[begin]) * powers(back)[begin] + (end - begin).astype(np.uint64)).view(np.int64)
            rows = pa.array(own[begin])
            made = [pa.array(run), t.column("doc_id").take(rows), t.column("version").take(rows), pa.array(place[begin]), pa.array(place[end - 1]), pa.array((end - begin).astype(np.int32))]
            yield from pa.table(made, ["run", "doc_id", "version", "first", "last", "n"]).to_batches(max_chunksize=1 << 16)

    return prints.select("doc_id", "version", "lines", "sizes", "places").mapInArrow(over, "run long, doc_id long, version long, first int, last int, n int")


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``rank``, the number of rows of its run before it by doc_id. Rows are dealt by range, so that no task
    sees all rows of a run."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for t in batches:
            if not t.num_rows:
                continue
            run = t.column("run").to_numpy()
            new = np.concatenate([[True], run[1:] != run[:-1]])
            starts = np.flatnonzero(new)
            at = np.arange(len(run)) - starts[np.cumsum(new) - 1]
            if run[0] == last:
                at[: starts[1] if len(starts) > 1 else len(run)] += n
            last, n = run[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.full(len(run), part, np.int32)), pa.array(at)], [*t.schema.names, "part", "at"])

    dealt = found.repartitionByRange("run", "doc_id").sortWithinPartitions("run", "doc_id")
    kept = keep(dealt.mapInArrow(over, "run long, doc_id long, version long, first int, last int, n int, part int, at long"), "dealt")
    # of the runs that several ranges have, a row for each range
    cut = kept.groupBy("run").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("run")
    sizes = kept.join(cut, "run", "left_semi").groupBy("run", "part").agg(F.count("*").alias("size"))
    ahead = sizes.select("run", "part", F.coalesce(F.sum("size").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    out = keep(kept.join(ahead, ["run", "part"], "left").select(*found.columns, (F.col("at") + F.coalesce("ahead", F.lit(0))).alias("rank")), "runs")
    forget(found.sparkSession, kept.kept_at)
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: the aligned (index in a, index in b), ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, at, end = todo.pop()
        while lo < hi and at < end and a[lo] == b[at]:
            out.append((lo, at))
            lo, at = lo + 1, at + 1
        while lo < hi and at < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            out.append((hi, end))
        if lo == hi or at == end:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[at:end])
        place = {x: k for k, x in enumerate(a[lo:hi], lo) if in_a[x] == 1}
        common = [(place[x], k) for k, x in enumerate(b[at:end], at) if in_b[x] == 1 and x in place]
        tops: list[int] = []
        piles: list[int] = []
        back = [-1] * len(common)
        for k, (x, _) in enumerate(common):  # the longest increasing run of places in a
            n = bisect_left(tops, x)
            back[k] = piles[n - 1] if n else -1
            if n == len(tops):
                tops.append(x)
                piles.append(k)
            else:
                tops[n], piles[n] = x, k
        k, chain = piles[-1] if piles else -1, []
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        for x, y in chain:  # from the last anchor down; what lies after it is a gap of its own
            todo.append((x + 1, hi, y + 1, end))
            out.append((x, y))
            hi, end = x, y
        if chain:
            todo.append((lo, hi, at, end))
    return sorted(out)


def blocks(matched: list[tuple[int, int]], sizes: list[int], min_chars: int) -> list[tuple[int, int]]:
    """[from, to) of the common blocks on the later side that are long enough."""
    out, k = [], 0
    while k < len(matched):
        z = k + 1
        while z < len(matched) and matched[z][0] == matched[z - 1][0] + 1 and matched[z][1] == matched[z - 1][1] + 1:
            z += 1
        first, last = matched[k][1], matched[z - 1][1] + 1
        if sum(sizes[first:last]) >= min_chars:
            out.append((first, last))
        k = z
    return out


def aligned(met: DataFrame, prints: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, gone) for each pair of ``met`` (earlier, early, later, late: doc_ids and versions) with blocks."""
    if met.count() <= FEW:
        ids = met.select(F.col("earlier").alias("doc_id"), F.col("early").alias("version")).unionAll(met.select("later", "late")).distinct()
        prints = prints.join(F.broadcast(ids), ["doc_id", "version"], "left_semi")
    a = prints.select(F.col("doc_id").alias("earlier"), F.col("version").alias("early"), F.col("lines").alias("a"))
    b = prints.select(F.col("doc_id").alias("later"), F.col("version").alias("late"), F.col("lines").alias("b"), "sizes", "places")
    met = met.join(a, ["earlier", "early"]).join(b, ["later", "late"]).select("later", F.col("late").alias("version"), "a", "b", "sizes", "places")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            for doc, version, a, b, sizes, places in zip(*(t.column(c).to_pylist() for c in ("later", "version", "a", "b", "sizes", "places")), strict=True):
                found = [places[x] for first, last in blocks(align(a, b), sizes, min_chars) for x in range(first, last)]
                if found:
                    rows.append((doc, version, found))
            ids, versions, gone = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "version", "gone"])

    return met.mapInArrow(over, "doc_id long, version long, gone array<int>")


def deleted(prints: DataFrame, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, gone): the places of the lines to delete in each text, ascending."""
    spark = prints.sparkSession
    same = [F.xxhash64("lines").alias("whole"), F.size("lines").alias("n_lines")]
    heads = prints.groupBy(*same).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").drop("tail")
    known = keep(prints.select("*", *same).join(heads, ["whole", "n_lines"], "left").drop("whole", "n_lines"), "heads")
    chars = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)
    copies = known.where((F.col("doc_id") > F.col("head")) & (F.size("places") > 0) & (chars >= min_chars)).select("doc_id", "version", F.col("places").alias("gone")).dropDuplicates(["doc_id", "version"])
    texts = known.where("head is null or doc_id = head")

    found = keep(runs(texts, min_chars), "runs")
    shared = found.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("run")
    held = numbered(found.join(shared, "run", "left_semi"))
    forget(spark, found.kept_at)
    left, gone, lo, hi = held.where("rank > 0"), None, 0, max(rare, 1)
    while True:
        late = left.select("run", F.col("doc_id").alias("later"), F.col("version").alias("late"))
        early = held.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select("run", F.col("doc_id").alias("earlier"), F.col("version").alias("early"))
        met = keep(late.join(early, "run").where("earlier < later").drop("run").distinct(), "pairs")
        each = aligned(met, texts, min_chars)
        # as many lists as the document has partners, each within its own lines
        every = (gone.unionAll(each) if gone else each).groupBy("doc_id", "version").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
        before, gone = (gone, left, met), keep(every, "gone")
        inside = F.size(F.filter("gone", lambda x: (x >= F.col("first")) & (x <= F.col("last"))))
        open_ = left.where(F.col("rank") > hi).join(gone, ["doc_id", "version"], "left").where(F.col("gone").isNull() | (inside < F.col("n")))
        left = keep(open_.select(*held.columns), "open")
        for x in before:
            if hasattr(x, "kept_at"):
                forget(spark, x.kept_at)
        if left.isEmpty():
            forget(spark, held.kept_at)
            return gone.unionAll(copies)
        lo, hi = hi, 8 * hi


def marked(docs: DataFrame, rare: int = RARE, min_chars: int = MIN_CHARS, name: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct ``name``: kept (the text without the deleted lines), n_lines (with a word), n_deleted."""
    prints = keep(fingerprints(docs), "lines")
    gone = keep(deleted(prints, rare, min_chars), "gone")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    own, version, found = (free_name(docs, x) for x in ("_id", "_version", "_found"))
    sizes = prints.select("doc_id", "version", F.size("lines").alias("n")).distinct()
    known = sizes.join(gone, ["doc_id", "version"], "left").select(F.col("doc_id").alias(own), F.col("version").alias(version), F.struct("gone", "n").alias(found))
    joined = docs.join(known, (docs["doc_id"].cast("long") == F.col(own)) & (F.xxhash64(docs["text"]) == F.col(version)), "left")
    places = F.col(f"{found}.gone")
    left = let(F.split(docs["text"], "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: F.get(x, i)), "\n"))
    out = F.struct(
        F.when(places.isNull(), docs["text"]).otherwise(left).alias("kept"),
        F.coalesce(F.col(f"{found}.n"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_deleted"),
    )
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], out.alias(name))
