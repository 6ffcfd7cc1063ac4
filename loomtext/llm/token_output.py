"""Token-ID output: documents become Parquet files of token lists that allow selective reads.

Format: a folder of ``part-*.parquet`` and a ``manifest`` table (Parquet). A part holds the columns ``doc_id``,
``n_tokens`` (with the end id) and ``tokens`` (list<int32>), in ascending order of doc_id; parts are in that order too.
Ids are dictionary-encoded where the dictionary pays and plain otherwise, doc_id and n_tokens are delta-encoded
(DELTA_BINARY_PACKED), row groups hold a bounded number of tokens (a longer document stands alone), and page indexes are
written. So a reader of lengths
never touches token pages, and a reader of a doc_id range opens only the row groups whose statistics meet it.
The manifest has one row per part: its file, first and last doc_id, number of documents and of tokens, and ``start``,
the number of ids before it. It names the files of the attempts that succeeded; what a lost executor left is not read.

Defined cases: null and empty texts are the end id alone; repeated doc_ids stand next to each other, ordered by a hash of
the text, and equal rows in any order, which shows nowhere; null doc_ids come first; a text of any length is one row; an empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, forget, ragged, scratch, small_batches, split_words, tables

#: Words whose ids a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 3_000_000
#: Text that one output file is to hold, in bytes.
FILE_BYTES = 256 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Encoder:
    """Whole texts to ids, by way of their distinct white-space words: the vocabulary's pre-tokenizer never crosses ASCII
    white space, so a text's ids are those of its words in order, and each word is encoded once. ``whole`` turns that
    off for vocabularies where it doesn't hold."""

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self._clear()

    def _clear(self) -> None:
        """Nothing is known. A word is found by a 128-bit hash: its low half in ``low`` (ascending), where ``slot`` is
        its number; ``high``, ``at`` and ``n`` go by that number, and the ids lie at flat[at : at + n]."""
        self.low, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.high, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], []
        for k in range(0, len(words), 20_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[k : k + 20_000]], add_special_tokens=False)]
            n.append(np.fromiter(map(len, got), np.int32, len(got)))
            flat.append(np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n[-1].sum())))
        return (np.concatenate(flat), np.concatenate(n)) if n else (np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones."""
        if not len(self.low):
            return np.full(len(low), -1, np.int64)
        at = np.minimum(np.searchsorted(self.low, low), len(self.low) - 1)
        slot = self.slot[at].astype(np.int64)
        return np.where((self.low[at] == low) & (self.high[slot] == high), slot, -1)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, which are learned if they are new."""
        from xxhash import xxh3_128_digest

        both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        high, low = both[:, 0], both[:, 1]
        if len(self.slot) + len(words) > CACHE_WORDS:
            self._clear()
        place = self._find(low, high)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, n = self._ids([words[k] for k in new.tolist()])
            first = len(self.n)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n, dtype=np.int64) - n])
            self.flat, self.n, self.high = np.concatenate([self.flat, ids]), np.concatenate([self.n, n]), np.concatenate([self.high, high[new]])
            place[new] = first + np.arange(len(new))
            order = new[np.argsort(low[new], kind="stable")]
            where = np.searchsorted(self.low, low[order])
            self.low, self.slot = np.insert(self.low, where, low[order]), np.insert(self.slot, where, place[order].astype(np.int32))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's ids."""
        if self.whole:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))
        codes, n_words, words = split_words(texts)
        place = self._places(words.to_pylist())[codes]
        n = self.n[place].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        edges = np.concatenate([[0], np.cumsum(n_words)])
        return self.flat[ragged(self.at[place], n)], np.diff(before[edges])


_known: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, whole: bool) -> Encoder:
    """A worker keeps its encoder, and the words that it knows, from task to task."""
    if (path, whole) not in _known:
        _known.clear()
        _known[path, whole] = Encoder(path, whole)
    return _known[path, whole]


def write(docs: DataFrame, out: str, vocabulary: str, end_id: int = 1, row_group_tokens: int = 1 << 20, whole: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files under ``out`` and return the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    names = "file string, part int, first_doc long, last_doc long, n_docs long, n_tokens long"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, folder = _open(out)
        encode, sink, stream, held, n_held = encoder(vocabulary, whole).encode, None, None, [], 0
        first = last = None
        n_docs = n_tokens = 0
        name = f"{folder}/part-{part:06d}-{context.taskAttemptId()}.parquet"

        def flush() -> None:
            nonlocal held, n_held
            if held:
                sink.write_table(pa.concat_tables(held).combine_chunks(), row_group_size=1 << 30)
            held, n_held = [], 0

        for t in tables(batches):
            ids, n = encode(column(t, "text"))
            edges = np.concatenate([[0], np.cumsum(n + 1)])
            full = np.full(edges[-1], end_id, np.int32)
            full[ragged(edges[:-1], n)] = ids
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(full))
            rows = pa.table({"doc_id": column(t, "doc_id"), "n_tokens": pa.array(n + 1), "tokens": lists})
            if sink is None:
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(name)
                sink = pq.ParquetWriter(
                    stream, rows.schema, compression="zstd", compression_level=1, use_dictionary=["tokens.list.element"], write_page_index=True, data_page_version="2.0",
                    column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, write_statistics=["doc_id", "n_tokens"],
                )
                first = rows.column("doc_id")[0].as_py()
            at = 0
            while at < rows.num_rows:
                to = int(np.searchsorted(edges, edges[at] + row_group_tokens - n_held, "right")) - 1
                if to <= at and n_held:
                    flush()
                    continue
                to = max(to, at + 1)  # a document beyond the bound
                held.append(rows.slice(at, to - at))
                n_held += int(edges[to] - edges[at])
                at = to
            last = rows.column("doc_id")[-1].as_py()
            n_docs, n_tokens = n_docs + rows.num_rows, n_tokens + int(edges[-1])
        if sink is not None:
            flush()
            sink.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name.rsplit("/", 1)[1], "part": part, "first_doc": first, "last_doc": last, "n_docs": n_docs, "n_tokens": n_tokens}], pa.schema([("file", pa.string()), ("part", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    spread = narrow.repartitionByRange(_files(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    spread.mapInArrow(save, names).write.parquet(f"{out}/written")
    parts = spark.read.parquet(f"{out}/written")
    # one row per file, so the running total over them is small
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).coalesce(1).write.parquet(f"{out}/manifest")
    forget(spark, f"{out}/written")
    return spark.read.parquet(f"{out}/manifest")


def _files(docs: DataFrame) -> int:
    """As many files as the measured text asks for, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES), 1)


def read(spark: SparkSession, out: str, tokens: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents from token files: (doc_id, start, n_tokens, ids_crc32, tokens). ``first`` and ``last`` bound doc_id and
    select files by the manifest and row groups by their statistics; without ``tokens`` no token page is read, and
    ids_crc32 and tokens are null."""
    small_batches(spark)
    parts = spark.read.parquet(f"{out}/manifest")
    if first is not None:
        parts = parts.where(F.col("last_doc") >= first)
    if last is not None:
        parts = parts.where(F.col("first_doc") <= last)
    columns = ["doc_id", "n_tokens"] + ["tokens"] * tokens
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("tokens", pa.list_(pa.int32()))]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, folder = _open(out)
                with fs.open_input_file(f"{folder}/{file}") as f:
                    source = pq.ParquetFile(f)
                    for g in range(source.num_row_groups):
                        stats = source.metadata.row_group(g).column(0).statistics
                        if stats is not None and stats.has_min_max and ((first is not None and stats.max < first) or (last is not None and stats.min > last)):
                            start += int(np.sum(source.read_row_group(g, columns=["n_tokens"]).column(0).to_numpy()))
                            continue
                        t = source.read_row_group(g, columns=columns).combine_chunks()
                        n = column(t, "n_tokens").to_numpy()
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        crc = lists = pa.nulls(t.num_rows)
                        if tokens:
                            lists = column(t, "tokens")
                            ids, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
                            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                            crc = pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64())
                        rows = pa.table([column(t, "doc_id"), pa.array(starts), pa.array(n), crc.cast(pa.int64()), lists.cast(pa.list_(pa.int32()))], schema=pa.schema(kinds))
                        if first is not None or last is not None:
                            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                            rows = rows.filter(pa.array((ids >= (first if first is not None else ids)) & (ids <= (last if last is not None else ids))))
                        yield from rows.to_batches(max_chunksize=4096)

    spread = parts.select("file", "start").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, tokens array<int>")


def digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ids stay in the Python workers."""
    small_batches(spark)
    parts = spark.read.parquet(f"{out}/manifest").select("file", "start")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, folder = _open(out)
                with fs.open_input_file(f"{folder}/{file}") as f:
                    source = pq.ParquetFile(f)
                    for g in range(source.num_row_groups):
                        t = source.read_row_group(g).combine_chunks()
                        n = column(t, "n_tokens").to_numpy()
                        lists = column(t, "tokens")
                        edges = lists.offsets.to_numpy().tolist()
                        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([column(t, "doc_id"), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(n.sum())

    # one short row per file: dealt one by one
    return parts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def run(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new folder of token files and return what the files hold, per document."""
    out = scratch(spark, "tokens")
    write(docs, out, vocabulary, end_id)
    return digests(spark, out)
