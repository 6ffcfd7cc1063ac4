"""Benchmark decontamination on a distributed positional inverted index.

``build`` stores the postings of all words of all documents. The index is document-sharded: a shard is the work of one
task on a bounded run of text, one row of the index table, with its documents, its words and, per word, the sorted
positions where it stands, as compressed delta lists. Words stand in the order of their frequency in the shard and lists
in chunks, so that the lists of rare words are opened without those of frequent ones. Positions count through the shard
and skip one between documents, so that no phrase crosses from one document into the next.

``blocks_of`` turns the queries into blocks of bounded size, a row each of a table in the shared folder: made by the tasks
that read the items, never by the driver, and read by the tasks that hold shards, one block at a time. So the index is
scanned once, whatever the number of blocks, and no row is shuffled.

A phrase is looked for in a shard only if the shard has all its words, tested from those that are rarest among the queries.
It starts from the list of its rarest word in the shard, shifts it by the word's offset in the phrase, and intersects it
with the shifted list of the next rarest word, until all words are met: exact phrase matches, for all phrases of a block
at once. ``proximity`` finds items all of whose words stand within a number of words, in any order, again from the rarest
list. Words are compared as bytes, so matches are exact.

Defined cases: null and empty texts have no words; an item without words has no window; an item with a null item_id
marks words but is not counted or listed; repeated items count once per item_id; rows with the same doc_id stay apart
rows; of equally rare words the first in the phrase goes first, which changes no result; an item of any length is dealt
over blocks by its windows, for ``proximity`` it is one; empty tables give empty results or zero counts. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keep, ragged, small_batches, split_words, tables

#: Text of one shard in bytes; windows of one block of queries; positions in a chunk of lists.
SHARD_BYTES = 4 << 20
BLOCK_WINDOWS = 1 << 18
CHUNK = 1 << 16
#: Shards that a task holds open while it reads the blocks, and blocks that it keeps for the next shards.
OPEN_SHARDS, OPEN_BLOCKS = 2, 2
INDEX = "shard long, doc_ids binary, doc_words binary, terms binary, df binary, begins binary, postings array<binary>"


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small deltas leave most planes empty."""
    x = np.ascontiguousarray(x)
    return x.itemsize.to_bytes(1) + len(x).to_bytes(8) + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    width, n = raw[0], int.from_bytes(raw[1:9])
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder."""
    small_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, t in enumerate(tables(batches, limit=SHARD_BYTES)):
            codes, n, words = split_words(column(t, "text"), lower=True, alnum=True)
            count = np.bincount(codes, minlength=len(words))
            rank = np.argsort(count, kind="stable")
            rank = rank[count[rank] > 0]  # words from the rarest on
            place = np.zeros(len(words), np.int64)
            place[rank] = np.arange(len(rank))
            kind = np.int32 if len(codes) + len(n) < 1 << 31 else np.int64
            codes, df = place.astype(np.int32)[codes], count[rank]
            position = np.arange(len(codes), dtype=kind) + np.repeat(np.arange(len(n), dtype=kind), n)  # one is left free after each document
            order = np.argsort(codes, kind="stable")
            first = np.cumsum(df) - df
            position = position[order]
            delta = np.diff(position, prepend=kind(0))
            delta[first] = position[first]
            del codes, order, position
            chunk = first // CHUNK
            cuts = np.append(first[np.flatnonzero(np.diff(chunk, prepend=-1))], len(delta)).tolist()
            ids = column(t, "doc_id")
            joined = b"\n".join(words.take(pa.array(rank)).to_pylist())
            row = [part + k, _pack(np.stack([pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).cast(pa.int64()).to_numpy()], 1).ravel()), _pack(n.astype(np.uint32)), len(joined).to_bytes(8) + pa.compress(joined, "zstd", asbytes=True)]
            row += [_pack(df.astype(np.uint32)), _pack(np.array(cuts[:-1], np.int64)), [_pack(delta[a:z].astype(np.uint32)) for a, z in zip(cuts, cuts[1:], strict=False)]]
            yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in row[:6]), pa.array([row[6]], pa.list_(pa.binary()))], ["shard", "doc_ids", "doc_words", "terms", "df", "begins", "postings"])

    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, INDEX), "postings")


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        ids = _unpack(row["doc_ids"], "<i8").reshape(-1, 2)
        self.doc_ids = [None if null else int(i) for i, null in ids]
        self.n = _unpack(row["doc_words"], "<u4").astype(np.int64)
        self.start = np.cumsum(self.n + 1) - (self.n + 1)
        self.size = int((self.n + 1).sum())
        raw = row["terms"]
        self.terms = pa.array(pa.decompress(raw[8:], int.from_bytes(raw[:8]), "zstd", asbytes=True).split(b"\n"), pa.binary())
        self.df = _unpack(row["df"], "<u4").astype(np.int64)
        if not len(self.df):
            self.terms = pa.array([], pa.binary())
        self.first = np.cumsum(self.df) - self.df
        self.begin = _unpack(row["begins"], "<i8")  # of each chunk
        self.chunk = np.searchsorted(self.begin, self.first, "right") - 1  # of each word
        self.raw, self.opened = row["postings"], {}

    def lists(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending codes: all their positions, and where each one's begin and how many there are."""
        n = self.df[codes]
        parts = [np.zeros(0, np.int64)]
        for c in np.unique(self.chunk[codes]).tolist():
            if c not in self.opened:
                self.opened[c] = _unpack(self.raw[c], "<u4")
            own = codes[self.chunk[codes] == c]
            parts.append(self.opened[c][ragged(self.first[own] - self.begin[c], self.df[own])].astype(np.int64))
        got = np.concatenate(parts)
        at = np.cumsum(n) - n
        total = np.cumsum(got)
        return total - np.repeat(total[at] - got[at], n) if len(got) else got, at, n


class Block:
    """Windows of items as phrases over a vocabulary of their own, and the distinct words of the items that begin here."""

    def __init__(self, items: list[tuple[str | None, list[bytes] | None, list[tuple[bytes, ...]]]], window: int):
        every = sorted({w for _, words, windows in items for part in (words or (), *windows) for w in part})
        code = {w: k for k, w in enumerate(every)}
        self.words = pa.array(every, pa.binary())
        self.items = [(item, [code[w] for w in words]) for item, words, _ in items if words]
        seen: dict[tuple, int] = {}
        owners: list[set] = []
        for item, _, windows in items:
            for w in windows:
                if seen.setdefault(w, len(owners)) == len(owners):
                    owners.append(set())
                owners[seen[w]].add(item)
        self.owners = [sorted(o, key=str) for o in owners]
        self.length = np.array([len(w) for w in seen], np.int64)
        self.phrase = np.full((len(seen), window), -1, np.int32)
        for k, w in enumerate(seen):
            self.phrase[k, : len(w)] = [code[x] for x in w]
        often = np.append(np.bincount(self.phrase[self.phrase >= 0], minlength=len(every)), len(seen) * window + 1)
        self.turn = np.argsort(often[self.phrase], axis=1, kind="stable").astype(np.int8)  # offsets, from the rarest word on

    def codes_in(self, shard: Shard) -> np.ndarray:
        """The shard's code of each word of the block, -1 where it has none, and -2 in the end for no word."""
        some = len(shard.terms) and len(self.words)
        own = pc.fill_null(pc.index_in(self.words, value_set=shard.terms), -1).to_numpy().astype(np.int64) if some else np.full(len(self.words), -1, np.int64)
        return np.append(own, -2)


def phrase_matches(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every exact occurrence."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, alive = block.codes_in(shard), np.arange(len(block.phrase))
    for j in range(block.phrase.shape[1]):  # phrases all of whose words the shard has; most go at the first word
        alive = alive[code[block.phrase[alive, block.turn[alive, j]]] != -1]
        if not len(alive):
            return none
    code = code[block.phrase[alive]]
    df = np.where(code >= 0, shard.df[np.maximum(code, 0)], np.iinfo(np.int64).max)
    turn = np.argsort(df, axis=1, kind="stable")
    rare = code[np.arange(len(code)), turn[:, 0]]
    used, inverse = np.unique(rare, return_inverse=True)
    positions, at, n = shard.lists(used)
    which = np.repeat(np.arange(len(code)), n[inverse])
    start = positions[ragged(at[inverse], n[inverse])] - np.repeat(turn[:, 0], n[inverse])
    for j in range(1, code.shape[1]):
        offset = turn[which, j]
        c = code[which, offset]
        used, inverse = np.unique(c, return_inverse=True)
        real = used >= 0  # the lists of words that no phrase is left to ask for stay closed
        positions, at, n = shard.lists(used[real])
        key = np.repeat(np.flatnonzero(real) << 40, n) + positions  # ascending
        want = (inverse << 40) + start + offset
        found = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        ok = (c < 0) | ((key[found] == want) if len(key) else False) & (start + offset >= 0)
        which, start = which[ok], start[ok]
        if not len(which):
            return none
    return alive[which], start


def near_matches(shard: Shard, block: Block, span: int) -> Iterator[tuple[int, int, int]]:
    """(item number, first position, last position) where all distinct words of the item stand within ``span`` words,
    one for each occurrence of its rarest word that has such a place: the shortest, then leftmost."""
    codes = block.codes_in(shard)
    for number, (_, words) in enumerate(block.items):
        own = np.unique(codes[words])
        if own[0] < 0:
            continue
        positions, at, n = shard.lists(own)
        lists = [positions[a : a + k] for a, k in zip(at, n, strict=True)]
        rare = int(np.argmin(n))
        for p in lists[rare].tolist():
            doc = int(np.searchsorted(shard.start, p, "right")) - 1
            low, high = max(int(shard.start[doc]), p - span + 1), min(int(shard.start[doc] + shard.n[doc]), p + span)
            events = sorted((int(q), k) for k, x in enumerate(lists) for q in x[np.searchsorted(x, low) : np.searchsorted(x, high)].tolist() if k != rare or q == p)
            best, count, left, have = None, {}, 0, 0
            for q, k in events:
                have += count.get(k, 0) == 0
                count[k] = count.get(k, 0) + 1
                while have == len(lists):
                    lo = events[left]
                    if q - lo[0] < span and (best is None or q - lo[0] < best[1] - best[0]):
                        best = (lo[0], q)
                    count[lo[1]] -= 1
                    have -= count[lo[1]] == 0
                    left += 1
            if best:
                yield number, *best


def blocks_of(items: DataFrame, window: int) -> list[tuple[str, int]]:
    """The items (item_id, text) as blocks of about ``BLOCK_WINDOWS`` windows, rows of a table in the shared folder; where
    each is: its file, and its number."""
    spark = items.sparkSession
    small_batches(spark)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_blocks = [], 0, 0
        here = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here + n_blocks]), pa.array([pickle.dumps(Block(held, window))], pa.binary())], ["block", "raw"])

        for t in tables(batches, limit=4 << 20):
            codes, n, words = split_words(column(t, "text"), lower=True, alnum=True)
            spelled, edge = words.to_pylist(), 0
            for item, k in zip(column(t, "item_id").to_pylist(), n.tolist(), strict=True):
                own = [spelled[c] for c in codes[edge : edge + k].tolist()]
                edge += k
                starts = max(1, k - window + 1) if k else 0
                for a in range(0, starts, BLOCK_WINDOWS):  # an item of more windows goes over several blocks
                    some = {tuple(own[i : i + window]) for i in range(a, min(starts, a + BLOCK_WINDOWS))}
                    held.append((item, sorted(set(own)) if a == 0 else None, sorted(some)))
                    size += len(some)
                    if size >= BLOCK_WINDOWS:
                        yield out()
                        held, size, n_blocks = [], 0, n_blocks + 1
        if held:
            yield out()

    known = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(over, "block long, raw binary")
    kept = keep(known, "query-blocks", **{"parquet.block.row.count.limit": "1"})
    where = kept.select("block", F.input_file_name().alias("file")).orderBy("block").collect()  # a short row per block
    return [(r["file"], r["block"]) for r in where]


_open: dict[tuple[str, int], Block] = {}


def block_at(file: str, number: int) -> Block:
    """A block of a table of blocks; a worker keeps the last ones."""
    if (file, number) not in _open:
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            source = pq.ParquetFile(f)
            for g in range(source.num_row_groups):
                t = source.read_row_group(g, columns=["block"])
                if number in t.column(0).to_pylist():
                    raw = source.read_row_group(g, columns=["raw"]).column(0)[t.column(0).to_pylist().index(number)].as_py()
                    break
            else:
                raise LookupError(f"block {number} is not in {file}")
        while len(_open) >= OPEN_BLOCKS:
            _open.pop(next(iter(_open)))
        _open[file, number] = pickle.loads(raw)
    return _open[file, number]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, Shard]]]:
    """Shards, some at a time."""
    held = []
    for b in batches:
        for row in b.to_pylist():
            held.append((row["shard"], Shard(row)))
            if len(held) == OPEN_SHARDS:
                yield held
                held = []
    if held:
        yield held


def contamination(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: words, words inside an occurrence of a window of an item, and the items with such windows."""
    blocks = blocks_of(items, window)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _opened(batches):
            edges = [np.zeros(shard.size + 1, np.int64) for _, shard in shards]
            found: list[dict[int, set]] = [{} for _ in shards]
            for place in blocks:
                block = block_at(*place)
                for (_, shard), edge, own in zip(shards, edges, found, strict=True):
                    which, start = phrase_matches(shard, block)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + block.length[which], -1)
                    doc = np.searchsorted(shard.start, start, "right") - 1
                    for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                        own.setdefault(d, set()).update(i for i in block.owners[w] if i is not None)
            for (_, shard), edge, own in zip(shards, edges, found, strict=True):
                before = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                hit = before[shard.start + shard.n] - before[shard.start]
                listed = [sorted(own.get(d, ())) for d in range(len(shard.n))]
                rows = [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.n), pa.array(hit), pa.array(list(map(len, listed)), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()), pa.array(hit > 0)]
                yield from pa.table(rows, names).to_batches(max_chunksize=4096)

    return index.mapInArrow(over, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def matches(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Exact phrase matches: (doc_id, item_id, word, n_words): an item's window stands at that word of the document."""
    return _places(index, items, window, None)


def proximity(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """Proximity matches: (doc_id, item_id, word, n_words): all words of the item stand in those n_words <= span words."""
    return _places(index, items, 10, span)


def _places(index: DataFrame, items: DataFrame, window: int, span: int | None) -> DataFrame:
    blocks = blocks_of(items, window)
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _opened(batches):
            for place in blocks:
                block = block_at(*place)
                for _, shard in shards:
                    if span is None:
                        found = [(i, s, s + block.length[w] - 1) for w, s in zip(*(x.tolist() for x in phrase_matches(shard, block)), strict=True) for i in block.owners[w]]
                    else:
                        found = [(block.items[k][0], a, z) for k, a, z in near_matches(shard, block, span)]
                    out = []
                    for item, a, z in found:
                        d = int(np.searchsorted(shard.start, a, "right")) - 1
                        out.append({"doc_id": shard.doc_ids[d], "item_id": item, "word": int(a - shard.start[d]), "n_words": int(z - a + 1)})
                    for k in range(0, len(out), 4096):
                        yield pa.RecordBatch.from_pylist(out[k : k + 4096], kinds)

    return index.mapInArrow(over, "doc_id long, item_id string, word long, n_words long").distinct()


def run(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Index ``docs`` and hold ``items`` (item_id, text) against it."""
    return contamination(build(docs), items, window)
