"""Byte-level BPE (B1-B10). Special tokens hold ids 0-12, bytes 13-268, merges follow."""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import regexes as R
from loomtext.operators.mix import max_chars as first_chars
from loomtext.plans.session import bounded_batches, checkpointed, forget

# Special tokens in id order.
SPECIALS = ["<|endoftext|>", "<|im_start|>", "<|im_end|>", *(f"<|buffer{k}|>" for k in range(1, 11))]
PAD = UNK = 0
BOS, EOS = 1, 2
FIRST_BYTE, FIRST_MERGE = 13, 269


def pretokens(text: Column) -> Column:
    """B1. Single CJK characters and marks; all else in runs, spaces included."""
    return F.regexp_extract_all(text, F.lit(R.CJK), F.lit(0))


def byte_ids(text: Column) -> Column:
    """B3. UTF-8 bytes as ids: each byte is a character of the same number in ISO-8859-1."""
    return F.transform(F.regexp_extract_all(F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) + FIRST_BYTE)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: Characters that the vocabulary is trained on, at most.
QUOTA = 500_000_000
#: Symbols of distinct pieces that the driver merges in a round, and pairs that it chooses from, at most.
PIECES, PAIRS = 1 << 20, 4096
#: Characters whose symbols are one row, and the writer's bound, since a reader holds the rows of a row group.
ROW_CHARS, ROW_GROUP = 1 << 19, {"parquet.block.size": str(16 << 20)}
#: A round goes on while the merged pair has this part of the count of the first one.
PART = 2
#: Stand for what is no symbol: the ends of a word and of a text, a special token, a symbol merged into the one before.
WORD_END, TEXT_END, SPECIAL, GONE = 0, 1, 2, 3
#: Bytes that are not in UTF-8, for the first three.
_MARKS = [b"\xff", b"\xfe", b"\xfd"]
_SYMBOLS = np.append(np.arange(253) + FIRST_BYTE, [SPECIAL, TEXT_END, WORD_END]).astype(np.int32)
_WORD = re.compile(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), R.CJK))
_SPECIAL = re.compile("|".join(map(re.escape, sorted(SPECIALS, key=len, reverse=True))))


def train(docs: DataFrame, vocab_size: int, max_chars: int = QUOTA, order: str = "doc_id") -> Tokenizer:
    """B4. The most frequent pair merges first, the smallest of equals, until the vocabulary is full or no pair occurs
    twice; a corpus beyond the quota is cut to its first characters. Texts are cut between the symbols of pairs that are
    rarer than some number. A pair as frequent as that, of symbols or of what they merge into, has no place across a cut,
    since each of its places would be one of the rarer pair; so merging the distinct pieces by their counts, down to that
    number, is exact. The number is first a guess of what the last merge has, for pieces that stay in a table, with a
    lower one where merges are left; then, round by round, a part of what the first pair has, for pieces that the driver
    merges. Where these are too many, a round has one merge, that of the first pair."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = first_chars(docs.select(order, "text"), max_chars, order) if size > max_chars else docs
    kind = np.dtype(np.uint16 if vocab_size < 1 << 16 else np.uint32)
    symbols = checkpointed(texts.select("text").mapInArrow(_to_symbols(kind), "symbols binary"), "symbols", **ROW_GROUP)
    merges: list[tuple[int, int]] = []
    least = 0
    while least != 2 and (first := FIRST_MERGE + len(merges)) < vocab_size:
        whole = _merged(symbols, kind, merges, FIRST_MERGE) if merges else symbols
        top = _top_pairs(whole, kind, first, 2)
        if top:
            least = max(2, least // 4 if least else 2 * top[0][0] // (vocab_size - first))
            if len(top) == PAIRS:
                least = max(least, top[-1][0] + 1)
            if kept := [p for n, p in top if n >= least]:
                pieces = checkpointed(_counted(whole, kind, first, kept).mapInArrow(_pack(kind), ROWS), "pieces", **ROW_GROUP)
                merges += _rounds(pieces, kind, first, vocab_size, least)
            else:  # more equal pairs than are listed
                merges.append(divmod(top[0][1], first))
        if whole is not symbols:
            forget(spark, whole.kept_at)
        if not top:
            break
    forget(spark, symbols.kept_at)
    return Tokenizer(merges)


#: Pieces with ``WORD_END`` around them, and their counts as int64.
ROWS = "symbols binary, counts binary"


def _rounds(state: DataFrame, kind: np.dtype, first: int, vocab_size: int, least: int) -> list[tuple[int, int]]:
    """The merges of pairs that occur ``least`` times, over counted pieces, which are deleted."""
    merges: list[tuple[int, int]] = []
    while (at := first + len(merges)) < vocab_size and (top := _top_pairs(state, kind, at, least)):
        found = _round(state, top, kind, at, vocab_size, least)
        merges += found
        after = _merged(state, kind, found, at)
        forget(state.sparkSession, state.kept_at)
        state = after
    forget(state.sparkSession, state.kept_at)
    return merges


def _round(state: DataFrame, top: list[tuple[int, int]], kind: np.dtype, first: int, vocab_size: int, least: int) -> list[tuple[int, int]]:
    """The next merges, given the most frequent pairs."""
    most = top[0][0]
    least = max(least, -(-most // PART), top[-1][0] + 1 if len(top) == PAIRS else 0)
    while least <= most:
        pieces = checkpointed(_counted(state, kind, first, [p for n, p in top if n >= least]), "pieces")
        size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
        rows = pieces.collect() if size <= PIECES * kind.itemsize else None
        forget(state.sparkSession, pieces.kept_at)
        if rows is not None:
            return _merges([np.frombuffer(r["piece"], kind) for r in rows], [r["n"] for r in rows], first, vocab_size, least)
        least = min(2 * least, most) if least < most else most + 1
    return [divmod(top[0][1], first)]


def _top_pairs(state: DataFrame, kind: np.dtype, base: int, least: int) -> list[tuple[int, int]]:
    """(n, pair) of the most frequent pairs, the first merge at the front."""
    pairs = state.mapInArrow(_pair_counts(kind, base), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return [(r["n"], r["pair"]) for r in pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(PAIRS).collect()]


def _counted(state: DataFrame, kind: np.dtype, base: int, kept: list[int]) -> DataFrame:
    return state.mapInArrow(_pieces(kind, base, kept), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _merged(state: DataFrame, kind: np.dtype, merges: list[tuple[int, int]], first: int) -> DataFrame:
    return checkpointed(state.mapInArrow(_merge_symbols(kind, Merger(merges, first)), state.schema), "symbols", **ROW_GROUP)


def _texts(batches: Iterable[pa.RecordBatch], limit: int = ROW_CHARS) -> Iterator[list[str]]:
    """Groups of the texts that are there, of about ``limit`` characters; a longer one stands alone."""
    held, n = [], 0
    for batch in batches:
        for x in batch.column(0):
            if (t := x.as_py()) is not None:
                if held and n + len(t) > limit:
                    yield held
                    held, n = [], 0
                held.append(t)
                n += len(t)
    if held:
        yield held


def _to_symbols(kind: np.dtype):
    """Texts to rows of symbols, with ``WORD_END`` around words."""

    def rows(batches):
        for texts in _texts(batches):
            raw = _MARKS[0].join([b"", *(w.encode() for t in texts for w in _WORD.findall(t)), b""])
            yield pa.RecordBatch.from_pydict({"symbols": pa.array([_SYMBOLS[np.frombuffer(raw, np.uint8)].astype(kind).tobytes()], pa.binary())})

    return rows


def _pack(kind: np.dtype):
    """(piece, n) to rows of many."""

    def rows(batches):
        end, held, counts, size = bytes(kind.itemsize), [], [], 0

        def out():
            return pa.RecordBatch.from_pydict({"symbols": pa.array([end.join([b"", *held, b""])], pa.binary()), "counts": pa.array([np.array(counts, np.int64).tobytes()], pa.binary())})

        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(piece)
                counts.append(n)
                size += len(piece) + kind.itemsize
                if size >= ROW_CHARS * kind.itemsize:
                    yield out()
                    held, counts, size = [], [], 0
        if held:
            yield out()

    return rows


def _arrays(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Symbols of each row, and the counts of its pieces if it has them."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield np.frombuffer(batch.column(0)[k].as_buffer(), kind), np.frombuffer(batch.column(1)[k].as_buffer(), np.int64) if batch.num_columns > 1 else None


def _pair_codes(s: np.ndarray, base: int) -> np.ndarray:
    """The pair that begins at each place as a number; less than ``base`` or a multiple of it where a word ends."""
    return s[:-1].astype(np.int64) * base + s[1:]


def _pair_counts(kind: np.dtype, base: int):
    """Rows of symbols to (pair, n)."""

    def rows(batches):
        table = np.zeros(base * base, np.int64) if base <= 2048 else None
        for s, counts in _arrays(batches, kind):
            codes = _pair_codes(s, base)
            weight = None if counts is None else counts[np.minimum(np.cumsum(s[:-1] == WORD_END) - 1, len(counts) - 1)]
            if table is not None:
                table += np.bincount(codes, weight, len(table)).astype(np.int64)
                continue
            names, inverse = np.unique(codes, return_inverse=True)
            n, inside = np.bincount(inverse, weight).astype(np.int64), (names >= base) & (names % base > 0)
            yield pa.RecordBatch.from_pydict({"pair": names[inside], "n": n[inside]})
        if table is not None:
            names = np.flatnonzero(table)
            names = names[(names >= base) & (names % base > 0)]
            yield pa.RecordBatch.from_pydict({"pair": names, "n": table[names]})

    return rows


def _pieces(kind: np.dtype, base: int, kept: list[int]):
    """Rows of symbols to (piece, n): runs of symbols of which all neighbours are kept pairs."""

    def rows(batches):
        names, found, width = np.sort(np.array(kept, np.int64)), Counter(), kind.itemsize
        table = np.isin(np.arange(base * base), names) if base <= 2048 else None

        def out():
            return pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

        for s, counts in _arrays(batches, kind):
            codes = _pair_codes(s, base)
            near = np.concatenate([[False], np.isin(codes, names) if table is None else table[codes], [False]])
            edges = np.flatnonzero(near[1:] != near[:-1])
            raw = s.tobytes()
            parts = [raw[a:z] for a, z in zip((edges[::2] * width).tolist(), ((edges[1::2] + 1) * width).tolist(), strict=True)]
            if counts is None:
                found.update(parts)
            else:
                for x, n in zip(parts, counts[np.cumsum(s == WORD_END)[edges[::2]] - 1].tolist(), strict=True):
                    found[x] += n
            if len(found) > 200_000:
                yield out()
                found.clear()
        yield out()

    return rows


def _merge_symbols(kind: np.dtype, merger: Merger):
    def rows(batches):
        for batch in batches:
            for k, (s, _) in enumerate(_arrays([batch], kind)):
                more = {"counts": batch.column(1).slice(k, 1)} if batch.num_columns > 1 else {}
                yield pa.RecordBatch.from_pydict({"symbols": pa.array([merger(s.astype(np.int32)).astype(kind).tobytes()], pa.binary())} | more)

    return rows


class Merger:
    """Merges of pairs into the ids from ``first`` on, in their order, over arrays of symbols. Each merge goes to the places
    that it has: those of the pairs at the start, and what earlier merges have put beside each other."""

    def __init__(self, merges: list[tuple[int, int]], first: int):
        self.merges, self.first = merges, first
        self.base = max([first + len(merges), *(max(m) + 1 for m in merges)])
        codes = np.array([a * self.base + b for a, b in merges], np.int64)
        self.table = self.names = self.ranks = None
        if self.base <= 2048:
            self.table = np.full(self.base * self.base, len(merges), np.int32)
            self.table[codes] = np.arange(len(merges))
        else:
            order = np.argsort(codes)
            self.names, self.ranks = codes[order], order.astype(np.int32)

    def __reduce__(self):
        return Merger, (self.merges, self.first)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of pairs among the merges, their number for pairs that are none."""
        codes = a.astype(np.int64) * self.base + b
        if self.table is not None:
            return self.table[codes]
        if not self.merges:
            return np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.names, codes), len(self.names) - 1)
        return np.where(self.names[at] == codes, self.ranks[at], len(self.merges))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """``s`` (int32), which is changed, begins and ends with a mark."""
        after, before = np.arange(1, len(s) + 1, dtype=np.int32), np.arange(-1, len(s) - 1, dtype=np.int32)
        todo: list[list[np.ndarray]] = [[] for _ in self.merges]

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            some = np.flatnonzero(rank < len(self.merges))
            at, rank = at[some], rank[some].astype(np.uint16 if len(self.merges) < 1 << 16 else np.int32)
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a < z:
                    todo[rank[a]].append(at[a:z])

        put(np.arange(len(s) - 1, dtype=np.int32), self.rank(s[:-1], s[1:]))
        for k, (a, b) in enumerate(self.merges):
            if not todo[k]:
                continue
            at = np.sort(np.concatenate(todo[k]))
            at = at[np.append(True, at[1:] != at[:-1])]
            todo[k] = []
            z = after[at]
            is_pair = (s[at] == a) & (s[z] == b)
            at, z = at[is_pair], z[is_pair]
            if a == b and len(at):  # of overlapping places every other one, from the left
                start = np.flatnonzero(np.append(True, at[1:] != z[:-1]))
                odd = (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 1
                at, z = at[~odd], z[~odd]
            if not len(at):
                continue
            y = after[z]
            s[at], s[z] = self.first + k, GONE
            after[at], before[y] = y, at
            x = before[at]
            put(np.concatenate([x, at]), self.rank(np.concatenate([s[x], s[at]]), np.concatenate([s[at], s[y]])))
        return s[s != GONE]


def train_on(counts: dict[str, int], vocab_size: int) -> Tokenizer:
    """B4 over counted words."""
    words = sorted(counts)
    return Tokenizer(_merges([np.frombuffer(w.encode(), np.uint8).astype(np.int32) + FIRST_BYTE for w in words], [counts[w] for w in words], FIRST_MERGE, vocab_size))


def _merges(words: list[np.ndarray], counts: list[int], first: int, vocab_size: int, least: int = 2) -> list[tuple[int, int]]:
    """Merges, into the ids from ``first`` on, of pairs that occur ``least`` times. They go over one array of all words'
    symbols, -1 after each word. A merge looks for its pair over the array, and recounts only the pairs around the places
    that change."""
    end = np.array([-1], np.int32)
    s = np.concatenate([end, *(y for w in words for y in (w, end))]).astype(np.int32)
    weight = np.concatenate([[0], np.repeat(counts, [len(w) + 1 for w in words])]).astype(np.int64)
    total: Counter[tuple[int, int]] = Counter()

    def around(places: np.ndarray) -> list[tuple[tuple[int, int], int]]:
        """Weights of the distinct pairs that begin at these places."""
        places = places[(places >= 0) & (places + 1 < len(s))]
        places = places[(s[places] >= 0) & (s[places + 1] >= 0)]
        names, inverse = np.unique((s[places].astype(np.int64) << 32) | s[places + 1], return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, inverse, weight[places])
        return [((int(n) >> 32, int(n) & 0xFFFFFFFF), int(k)) for n, k in zip(names, sums, strict=True)]

    total.update(dict(around(np.arange(len(s)))))
    heap = [(-n, p) for p, n in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while first + len(merges) < vocab_size and heap:
        n, pair = heapq.heappop(heap)
        if -n != total[pair]:
            if total[pair] > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < least:
            break
        at = np.flatnonzero((s[:-1] == pair[0]) & (s[1:] == pair[1]))
        if pair[0] == pair[1] and len(at):  # of overlapping places every other one, from the left
            start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
        changed = Counter({p: -k for p, k in around(np.unique(np.concatenate([at - 1, at, at + 1])))})
        s[at] = first + len(merges)
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, weight = s[stay], weight[stay]
        at = at - np.arange(len(at))
        for p, k in around(np.unique(np.concatenate([at - 1, at]))):
            changed[p] += k
        merges.append(pair)
        for p, k in changed.items():
            if k:
                total[p] += k
                if total[p] > 0:
                    heapq.heappush(heap, (-total[p], p))
    return merges


class Tokenizer:
    def __init__(self, merges: list[tuple[int, int]]):
        self.merges = [tuple(m) for m in merges]
        self.rank = {m: FIRST_MERGE + k for k, m in enumerate(self.merges)}
        self.bytes = {FIRST_BYTE + b: bytes([b]) for b in range(256)}
        for k, (a, b) in enumerate(self.merges):
            self.bytes[FIRST_MERGE + k] = self.bytes[a] + self.bytes[b]
        self._merger = Merger(self.merges, FIRST_MERGE)
        self._cached = lru_cache(50_000)(self._encode_word)

    def __getstate__(self):
        return self.merges

    def __setstate__(self, merges):
        self.__init__(merges)

    @property
    def vocab_size(self) -> int:
        return FIRST_MERGE + len(self.merges)

    def _encode_word(self, word: str) -> tuple[int, ...]:
        """Lowest merge first, leftmost first: a heap over a linked list."""
        ids = [b + FIRST_BYTE for b in word.encode()]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, pair = heapq.heappop(heap)
            z = after[k]
            if z >= len(ids) or (ids[k], ids[z]) != pair:
                continue
            ids[k], ids[z], after[k] = r, -1, after[z]
            if after[k] < len(ids):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(ids) and (q := self.rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (q, a, (ids[a], ids[b])))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        """B2, B5."""
        if not isinstance(text, str):
            raise TypeError(f"text must be str, not {type(text).__name__}")
        out, at = [BOS] * bos, 0
        for m in [*_SPECIAL.finditer(text), None]:
            for w in _WORD.findall(text[at : m.start() if m else len(text)]):
                out += self._cached(w) if len(w) <= 64 else self._encode_word(w)
            if m:
                out.append(SPECIALS.index(m[0]))
                at = m.end()
        return out + [EOS] * eos

    def decode(self, ids: list[int], skip_specials: bool = True) -> str:
        """B6. Unknown ids become ``?``."""
        out = b"".join(self.bytes.get(i, b"?") if i >= len(SPECIALS) else b"" if skip_specials else SPECIALS[i].encode() for i in ids)
        return out.decode("utf-8", "replace")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """B7."""
        return [x.tolist() for x in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str], bos: bool = False, eos: bool = False, limit: int = 1 << 20) -> Iterator[np.ndarray]:
        """What ``encode`` gives for each text, by groups of about ``limit`` characters whose symbols are merged at once."""
        held: list[str] = []
        n = 0
        for t in texts:
            if not isinstance(t, str):
                raise TypeError(f"text must be str, not {type(t).__name__}")
            if held and n + len(t) > limit:
                yield from self._encode_group(held, bos, eos)
                held, n = [], 0
            held.append(t)
            n += len(t)
        if held:
            yield from self._encode_group(held, bos, eos)

    def _encode_group(self, texts: list[str], bos: bool, eos: bool) -> list[np.ndarray]:
        parts, special = [b""], []
        for t in texts:
            at = 0
            for m in _SPECIAL.finditer(t) if "<|" in t else ():
                parts += [w.encode() for w in _WORD.findall(t[at : m.start()])]
                parts.append(_MARKS[2])
                special.append(SPECIALS.index(m[0]))
                at = m.end()
            parts += [w.encode() for w in _WORD.findall(t[at:])]
            parts.append(_MARKS[1])
        s = self._merger(_SYMBOLS[np.frombuffer(_MARKS[0].join([*parts, b""]), np.uint8)])
        s = s[s != WORD_END]
        ends = np.flatnonzero(s == TEXT_END)
        s[s == SPECIAL] = special
        starts = np.append(0, ends[:-1] + 1)
        head, tail = np.array([BOS] * bos, np.int32), np.array([EOS] * eos, np.int32)
        return [np.concatenate([head, s[a:z], tail]) if bos or eos else s[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]

    def token_id(self, token: str) -> int:
        """B8. The unknown id for tokens that are none."""
        if token in SPECIALS:
            return SPECIALS.index(token)
        return next((i for i, b in self.bytes.items() if b == token.encode()), UNK)

    def save(self) -> str:
        """B9. The model as JSON."""
        return json.dumps({"merges": {f"{a} {b}": FIRST_MERGE + k for k, (a, b) in enumerate(self.merges)}, "special_tokens": {t: k for k, t in enumerate(SPECIALS)}, "_next_id": self.vocab_size})

    @classmethod
    def load(cls, model: str) -> Tokenizer:
        merges = json.loads(model)["merges"]
        return cls([tuple(map(int, k.split(" "))) for k, _ in sorted(merges.items(), key=lambda x: x[1])])


def encode_udf(tokenizer: Tokenizer, bos: bool = False, eos: bool = False):
    """B5, B7 over columns, a batch at a time."""
    shared = tokenizer

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        found = shared.encode_arrays([t for t in texts if t is not None], bos, eos)
        return pd.Series([None if t is None else next(found) for t in texts], texts.index, object)

    return encode


def decode_udf(tokenizer: Tokenizer, skip_specials: bool = True):
    """B6 over columns."""
    shared = tokenizer

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else shared.decode(x.tolist() if isinstance(x, np.ndarray) else [int(i) for i in x], skip_specials))

    return decode
