"""Exact substring dedup over a collection Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document. Steps:

1. ``runs``: a window of ``length`` bytes has an anchor, the leftmost of the 64-byte grams inside it whose hash is
   smallest. Equal windows have equal anchors at equal places. Consecutive windows with the same anchor are a run; its
   bytes are a segment (about ``length`` + 170 bytes). Every window is in one run.
2. Runs are counted by anchor and by segment digest (partial aggregation first, so copies cost nothing). An anchor seen
   once has no repeat; a segment seen twice is a repeat as a whole. Only anchors with several different segments are left,
   one segment of each kind.
3. ``Collection``: those segments are dealt by anchor, and each task builds the Burrows-Wheeler transform and the common
   prefixes of its segments column by column: every round inserts one more symbol of every segment, from the last to the
   first, at the place that rank counting gives, and updates the common prefixes around it. Transform, prefixes and suffix
   names lie in external files that each round reads and writes from front to end. A symbol is a block of 16 bytes,
   in phase with the anchor, which cuts the rounds to about 50 and holds all of a window but 16 bytes.
4. Suffixes that share the blocks inside a window are neighbours with a long common prefix; the window's remaining bytes
   on both sides are then compared exactly.
5. An anchor with more than ``HOT`` different segments would be too much for one task. Its windows are counted by 128-bit
   digest instead, again with partial aggregation; memory stays bounded and no window is left out.
6. Each document unites its repeated windows.

``passages`` finds passages of ``words`` words or more that also stand in another document, whatever their bytes, by the
same steps over words: an item is a word then, a block of the transform four words in phase with the anchor.

Segments are held equal by a 128-bit digest, of words by 64 bits beside their anchor's 64. Defined cases: null and empty
texts have no bytes; texts shorter than ``length`` lose nothing; rows with equal doc_id and text are two places, and so
repeat each other, but are one document for ``passages``; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import column, hash_words, keep, mixed, odd_numbers, ragged, release, small_batches, split_words, tables, trim

LENGTH, GRAM, BLOCK = 400, 64, 16
#: A span is where it begins times this, plus how much further it goes.
SPAN = 1 << 20
#: Words of a passage, and of an anchor in it.
WORDS, WORD_GRAM = 51, 8
#: Different segments of an anchor that one task takes; bytes of segments in one collection; entries read at a time.
HOT, SHARD_BYTES, CHUNK = 20_000, 4 << 20, 1 << 20
#: Bytes (or words) that are hashed at once; the arrays over them stay in a core's cache.
PIECE = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    m = int(odd_numbers(1, 23)[0])
    up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_table: list[np.ndarray] = []


def anchors(raw: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``raw``: the place of its anchor, and that gram's hash."""
    if not _table:
        _table.extend(_powers(2 * PIECE + 4096))
    up, down = (_powers(len(raw) + 1) if len(raw) >= len(_table[0]) else _table)[:2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    n = len(raw) - gram + 1
    h = mixed((total[gram:] - total[:n]) * down[:n])
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    return at, h[at]


def cut(at: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with equal anchors ``at``, none across parts that begin at ``begin``: part, first and last window."""
    part = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[: len(at)]
    fits = np.arange(len(at)) + length <= begin[part + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    stop = np.append(np.flatnonzero(new | ~fits), len(at))
    return part[first], first, stop[np.searchsorted(stop, first, "right")] - 1


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts as byte pieces: (bytes, text number of each part, where the part begins in the piece, and in its text).
    Long texts are cut with an overlap of length - 1, short ones stand side by side."""
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    parts: list[tuple[int, int, int]] = []
    size = 0

    def out():
        begin = np.cumsum([0] + [z - a for _, a, z in parts])
        own = np.concatenate([raw[edges[k] + a : edges[k] + z] for k, a, z in parts])
        return own, np.array([k for k, _, _ in parts]), begin, np.array([a for _, a, _ in parts])

    for k, n in enumerate(np.diff(edges).tolist()):
        for a in range(0, max(n - length + 1, 0), PIECE):
            z = min(n, a + PIECE + length - 1)
            if parts and size + z - a > PIECE:
                yield out()
                parts, size = [], 0
            parts.append((k, a, z))
            size += z - a
    if parts:
        yield out()


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, first, last, anchor, key, d1, d2): windows first..last of a text share the gram at ``anchor``."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "version", "first", "last", "anchor", "key", "d1", "d2"]

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, versions, texts = column(t, "doc_id"), column(t, "version"), column(t, "text")
        for raw, text, begin, base in pieces(texts, length):
            if len(raw) < length:
                continue
            at, h = anchors(raw, length)
            own, first, last = cut(at, begin, length)
            view = raw.tobytes()
            both = np.frombuffer(b"".join([xxh3_128_digest(view[a : z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            shift = base[own] - begin[own]
            rows = pa.array(text[own])
            yield pa.RecordBatch.from_arrays([ids.take(rows), versions.take(rows), *(pa.array(x) for x in (first + shift, last + shift, at[first] + shift, h[first].view(np.int64), both[:, 0], both[:, 1]))], names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches, limit=4 << 20):
            yield from made(t)
        trim()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where(F.octet_length("text") >= length)
    return known.mapInArrow(over, ", ".join(f"{n} long" for n in names))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words_in(said: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of some bytes begins, its size, and a hash of it; no word goes across ``edges``."""
    full = ~_SPACE[said]
    opens = full.copy()
    opens[1:] &= ~full[:-1]
    edges = edges[edges < len(said)]
    opens[edges] = full[edges]
    start = np.flatnonzero(opens)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    size = np.add.reduceat(full, start, dtype=np.int64)  # all that is no space up to the next one
    up = np.multiply.accumulate(np.full(int(size.max()), int(odd_numbers(1, 29)[0]), np.uint64))
    spelled = (said[full].astype(np.uint64) + np.uint64(1)) * up[ragged(np.zeros(len(size), np.int64), size)]
    return start, size, mixed(np.add.reduceat(spelled, np.cumsum(size) - size) + size.astype(np.uint64))


def shared_in(raw: bytes, found: list[tuple[int, int]], words: int) -> int:
    """The words of a text in its windows of ``words`` words that are equal to one inside ``found`` ([from, to) of words):
    a passage that stands several times in a document was found at one of its places."""
    every = words_in(np.frombuffer(raw, np.uint8), np.zeros(0, np.int64))[2]
    up, down = _powers(len(every) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(every * up[:-1], dtype=np.uint64)])
    window = (total[words:] - total[:-words]) * down[: len(every) - words + 1]
    seen = np.zeros(len(window), bool)
    for a, z in found:
        seen[a : z - words + 1] = True
    hit = np.flatnonzero(np.isin(window, window[seen]))
    return int(np.minimum(np.diff(hit, append=hit[-1] + words), words).sum()) if len(hit) else 0


def word_runs(docs: DataFrame, words: int) -> DataFrame:
    """As ``runs``, over words: (doc_id, version, first, last, anchor, key, d1, begin, size); first, last and anchor count
    words, begin and size are the bytes of the segment."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "version", "first", "last", "anchor", "key", "d1", "begin", "size"]

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, versions, texts = column(t, "doc_id"), column(t, "version"), column(t, "text")
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        said = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
        inner = edges[:-1] - edges[0]
        start, size, every = words_in(said, inner)
        stop = start + size
        n = np.diff(np.searchsorted(start, np.append(inner, len(said))))
        whole = np.concatenate([[0], np.cumsum(n)])
        text_at = np.repeat(inner, n)
        for a in range(0, len(every) - words + 1, PIECE):  # each window begins in one piece
            z = min(len(every), a + PIECE + words - 1)
            low, high = np.searchsorted(whole, a, "right") - 1, np.searchsorted(whole, z, "left")
            begin = np.clip(whole[low : high + 1] - a, 0, z - a)
            raw = every[a:z]
            at, h = anchors(raw, words, WORD_GRAM)
            own, first, last = cut(at, begin, words)
            if not len(first):
                continue
            view = raw.tobytes()
            d1 = np.fromiter((xxh3_64_intdigest(view[8 * f : 8 * (x + words)]) for f, x in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
            text = own + low
            shift = a - whole[text]
            from_, to = start[a + first] - text_at[a + first], stop[a + last + words - 1] - text_at[a + first]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([ids.take(rows), versions.take(rows), *(pa.array(x) for x in (first + shift, last + shift, at[first] + shift, h[first].view(np.int64), d1, from_, to - from_))], names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches, limit=2 << 20):
            yield from made(t)
        trim()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where(F.octet_length("text") >= 2 * words - 1)
    return known.mapInArrow(over, ", ".join(f"{n} long" for n in names))


class Collection:
    """The Burrows-Wheeler transform and common prefixes of strings of symbols >= 1, built column by column.

    Three external files hold, in suffix order, the symbol before each suffix (0: none), its common prefix with the
    suffix before it, and its name (string * 256 + length). The end of a string is smaller than every symbol, and ends
    go by string number."""

    def __init__(self, folder: str):
        self.folder, self.round = folder, 0

    def _path(self, what: str, k: int) -> str:
        return os.path.join(self.folder, f"{what}.{k}")

    def load(self, what: str, kind: str) -> np.ndarray:
        return np.fromfile(self._path(what, self.round), kind)

    def build(self, symbols: np.ndarray, n: np.ndarray) -> None:
        m, end = len(n), np.cumsum(n)
        before = lambda of, t: np.where(n[of] > t, symbols[np.maximum(end[of] - 1 - t, 0)], 0).astype(np.int32)
        every = np.arange(m)
        count = np.zeros(int(symbols.max()) + 2, np.int64)
        bwt = before(every, 0)
        bwt.tofile(self._path("bwt", 0))
        np.zeros(m, np.uint8).tofile(self._path("lcp", 0))
        (every * 256).astype(np.int64).tofile(self._path("name", 0))
        count += np.bincount(bwt, minlength=len(count))
        place = every.copy()  # of each string's longest suffix so far
        for t in range(1, int(n.max()) + 1):
            of = np.flatnonzero(n >= t)
            c = before(of, t - 1)
            need = np.zeros(len(count), bool)
            need[c] = True
            fresh = np.zeros(0, bool)
            # one pass over the transform: where the symbols that are inserted now stand
            found, start = [], 0
            for chunk in self._chunks("bwt", np.int32):
                found.append(np.flatnonzero(need[chunk]) + start)
                found[-1] = np.stack([found[-1], chunk[found[-1] - start].astype(np.int64)])
                start += len(chunk)
            at, symbol = np.concatenate(found, 1)
            order = np.argsort(symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            smaller = m + np.cumsum(count) - count - count[0]  # suffixes that begin with a smaller symbol
            opens = np.ones(len(at), bool)
            opens[1:] = symbol[1:] != symbol[:-1]
            group = np.flatnonzero(opens)
            target = smaller[symbol] + np.arange(len(at)) - np.repeat(group, np.diff(np.append(group, len(at))))
            fresh = np.zeros(start, bool)
            fresh[place[of]] = True
            new = fresh[at]
            # common prefixes of inserted suffixes and of their successors
            touched = np.flatnonzero(new | np.append(False, new[:-1]))
            prefix = np.zeros(len(touched), np.int64)
            inner = ~opens[touched]
            k = touched[inner]
            prefix[inner] = 1 + self._least(at[k - 1] + 1, at[k])
            who = np.full(start, -1, np.int64)
            who[place[of]] = of
            string = who[at[new]]
            added = before(string, t)
            place[string] = target[new]
            self._merge(target[new], added, (string * 256 + t).astype(np.int64), target[touched], np.minimum(prefix, 255).astype(np.uint8))
            count += np.bincount(added, minlength=len(count))

    def _chunks(self, what: str, kind) -> Iterator[np.ndarray]:
        with open(self._path(what, self.round), "rb") as f:
            while len(x := np.fromfile(f, kind, CHUNK)):
                yield x

    def _least(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Smallest common prefix in each range a..z."""
        step = 32
        lcp = self.load("lcp", "u1")
        grid = np.concatenate([lcp, np.full(-len(lcp) % step, 255, np.uint8)]).reshape(-1, step)
        head, tail = np.minimum.accumulate(grid, 1), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]
        levels = [grid.min(1)]
        while 2 ** len(levels) <= len(grid):
            k = 2 ** (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-k], levels[-1][k:]))
        out = np.minimum(tail.ravel()[a], head.ravel()[z])
        lo, hi = a // step + 1, z // step
        same = lo > hi
        far = np.flatnonzero(lo < hi)
        size = np.frexp(hi[far] - lo[far])[1] - 1
        for s in np.unique(size).tolist():
            i = far[size == s]
            out[i] = np.minimum(out[i], np.minimum(levels[s][lo[i]], levels[s][hi[i] - (1 << s)]))
        i = np.flatnonzero(same)
        if len(i):
            reach = a[i, None] + np.arange(step)
            near = np.where(reach <= z[i, None], grid.ravel()[np.minimum(reach, grid.size - 1)], 255)
            out[i] = near.min(1)
        return out.astype(np.int64)

    def _merge(self, places: np.ndarray, symbols: np.ndarray, names: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> None:
        """Write the next files: entries inserted at ``places`` (of the new order), common prefixes set at ``at``."""
        turn = np.argsort(places)
        places, symbols, names = places[turn], symbols[turn], names[turn]
        turn = np.argsort(at)
        at, prefix = at[turn], prefix[turn]
        for what, kind, values in (("bwt", np.int32, symbols), ("lcp", np.uint8, np.zeros(len(places), np.uint8)), ("name", np.int64, names)):
            old, done, put = self._path(what, self.round), 0, 0
            with open(self._path(what, self.round + 1), "wb") as f:
                for chunk in [*self._chunks(what, kind), None]:
                    if chunk is None:
                        n = len(places) - put
                        chunk = np.zeros(0, kind)
                    else:
                        # as many insertions as fall before the chunk's last entry
                        n = int(np.searchsorted(places[put:] - np.arange(len(places) - put), done + len(chunk) - 1 + 1, "left"))
                    full = np.empty(len(chunk) + n, kind)
                    here = np.zeros(len(full), bool)
                    here[places[put : put + n] - done] = True
                    full[here], full[~here] = values[put : put + n], chunk
                    if what == "lcp":
                        a, z = np.searchsorted(at, [done, done + len(full)])
                        full[at[a:z] - done] = prefix[a:z]
                    full.tofile(f)
                    done, put = done + len(full), put + n
            os.remove(old)
        self.round += 1


def repeated(segments: list[bytes], phase: np.ndarray, length: int, open_: np.ndarray, step: int = 1, owner: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, whether each of its windows also starts elsewhere among these segments, as ranges [from, to).
    Only segments that are ``open_`` are asked for. ``phase``: where the first block begins; ``step``: bytes of an item, at
    whose multiples windows start. With ``owner`` elsewhere means in a segment that is of another owner, or not open."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(segments) + bytes(BLOCK), np.uint8)
    n = np.maximum((size - phase) // BLOCK, 0)
    if not n.any():
        return []
    at = np.repeat(begin + phase, n) + BLOCK * ragged(np.zeros(len(n), np.int64), n)
    words = np.ascontiguousarray(raw[at[:, None] + np.arange(BLOCK)]).view(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    symbols = np.empty(len(order), np.int64)
    symbols[order] = np.cumsum(new)
    least = (length - BLOCK + step) // BLOCK  # whole blocks in any window
    with tempfile.TemporaryDirectory() as folder:
        c = Collection(folder)
        c.build(symbols, n)
        long = c.load("lcp", "u1") >= least
        name = c.load("name", "i8")
    member = long.copy()
    member[:-1] |= long[1:]
    interval = np.cumsum(~long)
    where = np.flatnonzero(member)
    text, interval = name[where] // 256, interval[where]
    asked = np.zeros(int(interval[-1]) + 1 if len(interval) else 1, bool)
    asked[interval[open_[text]]] = True
    some = asked[interval]
    where, text, interval = where[some], text[some], interval[some]
    block = phase[text] + BLOCK * (n[text] - name[where] % 256)
    hit: list[tuple[np.ndarray, np.ndarray]] = []
    inner = BLOCK * least
    for x in range(0, BLOCK, step):
        start = block - x
        ok = np.flatnonzero((start >= 0) & (start + length <= size[text]))
        if not len(ok):
            continue
        t, s, i = text[ok], start[ok], interval[ok]
        # the bytes of the window on both sides of its inner blocks
        width = length - inner
        edge = np.zeros((len(ok), -(-width // 8) * 8), np.uint8)
        reach = np.arange(width) + np.where(np.arange(width) >= x, inner, 0)
        edge[:, :width] = raw[(begin[t] + s)[:, None] + reach]
        both = edge.view(np.uint64)
        h = mixed(i.astype(np.uint64))
        for k in range(both.shape[1]):
            h = mixed(h ^ both[:, k])
        turn = np.argsort(h, kind="stable")
        a, b = turn[1:], turn[:-1]
        opens = np.ones(len(ok), bool)
        opens[1:] = ~((h[a] == h[b]) & (i[a] == i[b]) & (both[a] == both[b]).all(1))
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(ok)))
        if owner is None:
            again = count > 1
        else:
            who, closed = owner[t[turn]], ~open_[t[turn]]
            again = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | np.logical_or.reduceat(closed, first)
        twice = np.zeros(len(ok), bool)
        twice[turn] = np.repeat(again, count)
        twice &= open_[t]
        hit.append((t[twice], s[twice] // step))
    if not hit:
        return []
    t, s = (np.concatenate(x) for x in zip(*hit, strict=True))
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    opens = np.ones(len(t), bool)
    opens[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(t)) - 1
    return [(t[first], np.stack([s[first], s[last] + 1], 1))] if len(t) else []


def repeated_words(segments: list[bytes], place: np.ndarray, owner: np.ndarray, shared: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment of one document (``owner``) its windows of ``words`` words that also stand in a segment of another
    document, as ranges [from, to). Segments that are ``shared`` stand in several documents and aren't asked for. Words are
    numbers of 4 bytes here, four to a block; ``place``: the anchor's word."""
    codes, n, _ = split_words(pa.array(segments, pa.binary()).cast(pa.string()))
    raw, end = codes.astype(np.uint32).tobytes(), 4 * np.cumsum(n)
    each = [raw[z - 4 * k : z] for z, k in zip(end.tolist(), n.tolist(), strict=True)]
    return repeated(each, 4 * place % BLOCK, 4 * words, ~shared, 4, owner)


def _segments(rows: DataFrame, docs: DataFrame, begin: str, size: str) -> DataFrame:
    """``rows`` with their segment's bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.xxhash64("text").alias("text_version"), F.encode("text", "utf-8").alias("raw"))
    met = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("version") == F.col("text_version")))
    return met.select(*rows.columns, F.substring("raw", F.expr(f"cast({begin} + 1 as int)"), F.expr(f"cast({size} as int)")).alias("segment"))


KIND = ["key", "d1", "d2"]
FOUND = "doc_id long, version long, first long, last long"


def _solved(dealt: DataFrame, solve) -> DataFrame:
    """Windows (doc_id, version, first, last) that ``solve`` finds in the segments ``dealt`` by key; a collection holds
    whole keys."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(held[t], a, z) for ts, spans in solve(held) for t, (a, z) in zip(ts.tolist(), spans.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([f(r, a, z) for r, a, z in rows], pa.int64()) for f in (lambda r, a, z: r["doc_id"], lambda r, a, z: r["version"], lambda r, a, z: r["first"] + a, lambda r, a, z: r["first"] + z - 1)], ["doc_id", "version", "first", "last"])

        for b in batches:
            for r in b.to_pylist():
                if held and size > SHARD_BYTES and r["key"] != held[-1]["key"]:
                    yield out()
                    held, size = [], 0
                    trim()
                if held and all(r[c] == held[-1][c] for c in KIND):
                    continue  # rows with equal doc_id and text gave this segment twice
                held.append(r)
                size += len(r["segment"])
        if len(held) > 1:
            yield out()
        held = []
        trim()

    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "key").sortWithinPartitions(*KIND).mapInArrow(shards, FOUND)


def _digests(hot: DataFrame, windows_of) -> DataFrame:
    """(doc_id, version, first, w1, w2, shared): every window of the segments of ``hot`` by its digest."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                both = np.frombuffer(b"".join(map(xxh3_128_digest, windows_of(r["segment"]))), np.int64).reshape(-1, 2)
                n = len(both)
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]] * n, pa.int64()), pa.array([r["version"]] * n, pa.int64()), pa.array(r["first"] + np.arange(n)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([r["n"] > 1] * n)], ["doc_id", "version", "first", "w1", "w2", "shared"])

    return hot.dropDuplicates(KIND).mapInArrow(over, "doc_id long, version long, first long, w1 long, w2 long, shared boolean")


def windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, version, first, last): all windows first..last of that text also start elsewhere. A kept table."""
    known = keep(runs(docs, length), "runs")
    # one row stands for its kind, any of them: first() takes all its columns from one row, and is aggregated by hash
    place = [F.first(c).alias(c) for c in ("doc_id", "version", "first", "last", "anchor")]
    kinds = keep(known.groupBy(*KIND).agg(F.count("*").alias("n"), *place), "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    twice = kinds.where("n > 1").select("key", "d1", "d2")
    whole = known.join(twice, ["key", "d1", "d2"]).select("doc_id", "version", "first", "last")
    rows = kinds.join(several, "key")
    some = keep(_segments(rows, docs, "first", f"last - first + {length}"), "segments")

    def solve(held: list[dict]):
        phase = np.array([(r["anchor"] - r["first"]) % BLOCK for r in held])
        return repeated([r["segment"] for r in held], phase, length, np.array([r["n"] == 1 for r in held]))

    solved = _solved(some.where(F.col("m") <= hot), solve)
    each = _digests(some.where(F.col("m") > hot), lambda s: (s[k : k + length] for k in range(len(s) - length + 1)))
    again = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    hots = each.join(again, ["w1", "w2"]).select("doc_id", "version", "first", F.col("first").alias("last"))
    out = keep(whole.unionAll(solved).unionAll(hots), "windows")
    release(docs.sparkSession, known, kinds, some)
    return out


def passages(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, version, first, last): words first..last of that text are in passages of ``words`` words or more that also
    stand in another document. A kept table."""
    known = keep(word_runs(docs, words), "word-runs")
    doc = F.xxhash64("doc_id", "version")
    place = [F.first(c).alias(c) for c in ("doc_id", "version", "first", "last", "anchor", "begin", "size")]
    kinds = keep(known.groupBy("key", "d1").agg(F.when(F.min(doc) < F.max(doc), 2).otherwise(1).alias("n"), *place), "word-kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    whole = known.join(kinds.where("n > 1").select("key", "d1"), ["key", "d1"]).select("doc_id", "version", "first", "last")
    rows = kinds.join(several, "key").withColumn("d2", F.lit(0).cast("long"))
    some = keep(_segments(rows, docs, "begin", "size").drop("begin", "size"), "word-segments")

    def solve(held: list[dict]):
        codes: dict[tuple, int] = {}
        owner = np.array([codes.setdefault((r["doc_id"], r["version"]), len(codes)) for r in held])
        place = np.array([r["anchor"] - r["first"] for r in held])
        return repeated_words([r["segment"] for r in held], place, owner, np.array([r["n"] > 1 for r in held]), words)

    def spans(s: bytes) -> Iterator[bytes]:
        codes, _, spelled = split_words(pa.array([s], pa.binary()).cast(pa.string()))
        raw = hash_words(spelled)[codes].tobytes()
        return (raw[8 * k : 8 * (k + words)] for k in range(len(codes) - words + 1))

    solved = _solved(some.where(F.col("m") <= hot), solve)
    each = _digests(some.where(F.col("m") > hot), spans)
    again = each.groupBy("w1", "w2").agg(F.min(doc).alias("a"), F.max(doc).alias("z"), F.max("shared").alias("any")).where("any or a < z").select("w1", "w2")
    hots = each.where("not shared").join(again, ["w1", "w2"]).select("doc_id", "version", "first", F.col("first").alias("last"))
    found = whole.unionAll(solved).unionAll(hots).select("doc_id", "version", "first", (F.col("last") + words - 1).alias("last"))
    out = keep(found, "passages")
    release(docs.sparkSession, known, kinds, some)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, kept) for each row of ``docs`` (doc_id, text); kept
    holds the remaining bytes, which need not be whole characters; n_shared_words the words of the input text in passages
    of ``words`` words or more that another document has too."""
    if max(length, words) > SPAN // 4:
        raise ValueError(f"windows of more than {SPAN // 4}")
    # a span is one number: its kind, where it begins, and how much further it goes
    number = lambda kind, more: (F.lit(kind << 62) + F.col("first") * SPAN + F.col("last") - F.col("first") + more).alias("span")
    said = passages(docs, words, hot).select("doc_id", "version", number(1, 0))
    found = windows(docs, length, hot).select("doc_id", "version", number(0, length - 1))
    spans = found.unionAll(said).groupBy("doc_id", "version").agg(F.collect_list("span").alias("spans"))  # of one document
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("version").alias("span_version"), "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    met = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("version") == F.col("span_version")), "left").select("doc_id", "text", "spans")

    def united(spans: np.ndarray) -> list[tuple[int, int]]:
        """The union of ascending spans, as [from, to)."""
        if not len(spans):
            return []
        first, end = spans // SPAN, spans // SPAN + spans % SPAN + 1
        top = np.maximum.accumulate(end)
        opens = np.flatnonzero(np.append(True, first[1:] > top[:-1]))
        return list(zip(first[opens].tolist(), top[np.append(opens[1:], len(spans)) - 1].tolist(), strict=True))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            lists = column(t, "spans")
            every, edges = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            rows: list[tuple] = []
            for k, text in enumerate(t.column("text").to_pylist()):
                raw, own = (text or "").encode(), np.sort(every[edges[k] : edges[k + 1]])
                kind = np.searchsorted(own, 1 << 62)
                gone, said = united(own[:kind]), united(own[kind:] - (1 << 62))
                left = b"".join(raw[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), shared_in(raw, said, words) if said else 0, left))
            each = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield from pa.table([column(t, "doc_id"), *(pa.array(x, k) for x, k in zip(each, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept"]).to_batches(max_chunksize=1024)

    return met.mapInArrow(over, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, kept binary")


def run(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return dedup(docs, length).drop("kept")
