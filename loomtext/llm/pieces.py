"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units that no piece crosses (a run of spaces and the word after it), and the units that the
worker has not met yet are concatenated. ``suffix_array`` sorts all suffixes of that text by prefix doubling up to the
longest piece; every piece is binary-searched for its range of occurrences; the occurrences are the edges of a graph over
text positions, and are sorted by their end and relaxed in that order, for all units at once.

What relaxing means depends on the model. With ``kind="unigram"`` an edge adds its piece's score and the best sum stays.
A BPE model's segmentation is no best sum: there an edge may follow another if the two pieces, merged by the model's own
order, would not have merged across the seam (``Model.stable``). A sequence is what BPE gives if and only if all its
seams are stable, so exactly one edge survives at each position, and the result equals the merge loop's. Pieces whose
scores tie, or that merge out of order, break that argument; units that hold one are merged step by step (``merge``).
Characters outside of the vocabulary become byte pieces, or the unknown id without byte fallback. A unit beyond a batch
(``BATCH_CHARS``) is indexed window by window, and its edges are relaxed over all windows.

Defined cases: null and empty texts have no pieces; a null text decodes to a null; decoding gives back the text of every
encoded document, and U+FFFD for invalid bytes; ids outside of the vocabulary raise. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ragged, small_batches, tables, trim

#: Units whose ids a worker remembers; beyond it the memory starts anew.
CACHE_UNITS = 500_000
#: Characters that are indexed at once; about five edges start at each.
BATCH_CHARS = 150_000
#: Characters of a longer unit that are indexed at once.
WINDOW = 30_000
#: Bits of a symbol in the keys of four.
BITS = 16
SPACE = "▁"
FAR = 1 << 40


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of distinct keys >= 0, an eighth full at most: keys (-1: free) and values by place."""
    bits = max(4, (8 * len(keys)).bit_length())
    table, held = np.full((1 << bits) + len(keys) + 1, -1, np.int64), np.full((1 << bits) + len(keys) + 1, FAR, np.int64)
    for key, value, at in zip(keys.tolist(), values.tolist(), _slot(keys, bits).tolist(), strict=True):
        while table[at] >= 0:
            at += 1
        table[at], held[at] = key, value
    return table, held


def _rank_of(key: np.ndarray, table: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The values of keys, FAR for keys that the table lacks."""
    bits = len(bin(len(table))) - 3  # the table is a little longer than a power of two
    at = _slot(key, bits)
    found = table[at]
    out = np.where(found == key, held[at], FAR)
    left = np.flatnonzero((found != key) & (found >= 0))
    while len(left):
        at[left] += 1
        found = table[at[left]]
        same = found == key[left]
        out[left[same]] = held[at[left[same]]]
        left = left[~same & (found >= 0)]
    return out


class Model:
    """The vocabulary of a SentencePiece model, and what its merge order says of pairs of pieces."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.library, self.kind, self.size, self.unknown = m, kind, size, m.unk_id()
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        self.scores = np.array([m.get_score(i) for i in range(size)])
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.plain = m.normalize(" a  ﬁ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ"  # no normalization but the leading space
        #: What each id decodes to; control pieces to nothing.
        self.out = [b"" if m.is_control(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.text = {p: i for i, p in enumerate(self.pieces) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))}
        self.split_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.text)
        longest = max(map(len, self.text))
        self.ids = np.array(sorted(self.text.values()), np.int64)
        self.chars = np.zeros((len(self.ids), longest), np.int64)
        for k, i in enumerate(self.ids):
            self.chars[k, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.length = (self.chars > 0).sum(1)
        self.width = np.append(np.array(list(map(len, self.pieces))), 1)  # characters of each id; the last is an unknown one
        if kind == "bpe":
            self._order()

    def _order(self) -> None:
        """rank: when a piece is merged, -1 for single characters; left, right: the pieces of its last merge."""
        n = self.size + 1  # the last is a character outside of the vocabulary
        many = [i for p, i in self.text.items() if len(p) > 1]
        counts: dict[float, int] = {}
        for i in many:
            counts[self.scores[i]] = counts.get(self.scores[i], 0) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, n - 1, np.int64), np.full(n, n - 1, np.int64)
        for r, i in enumerate(sorted(many, key=lambda i: -self.scores[i])):
            self.rank[i] = r
        self.odd: set[int] = {i for i in many if counts[self.scores[i]] > 1}
        dead = []
        for i in many:
            parts = self.merge(self.pieces[i], stop=2)
            if i in self.odd:
                continue
            if len(parts) != 2:
                dead.append(i)
            elif max(self.rank[parts[0]], self.rank[parts[1]]) > self.rank[i]:
                self.odd.add(i)
            else:
                self.left[i], self.right[i] = parts
        self.dead = np.zeros(n, bool)  # never the result of merging
        self.dead[dead] = True
        keys, ranks = [], []
        for i in many:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.text.get(p[:k]), self.text.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(self.rank[i])
        self.pair, self.pair_rank = _hashed(np.array(keys, np.int64), np.array(ranks, np.int64))

    def merge(self, text: str, stop: int = 1) -> list[int]:
        """The merge loop: the adjacent pair of the best score merges, the leftmost of equals; ``stop``: pieces to leave
        at least. Ids, size for characters outside of the vocabulary."""
        at = list(text)
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(at) and (i := self.text.get(at[a] + at[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, at[a], at[b]))

        for k in range(len(at) - 1):
            offer(k, k + 1)
        left = len(at)
        while heap and left > stop:
            _, a, x, y = heapq.heappop(heap)
            b = after[a]
            if at[a] != x or b >= len(at) or at[b] != y:
                continue
            at[a], at[b], after[a] = x + y, "", after[b]
            if after[b] < len(at):
                before[after[b]] = a
            left -= 1
            offer(before[a], a)
            offer(a, after[a])
        return [self.text.get(p, self.size) for p in at if p]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when their texts are merged side by side. The merges of both are undone from
        the last; at every stage the pair at the seam must not have a merge that comes before the next one of its sides
        (the left side's merge wins a tie, being further left; the seam wins one against the right side's)."""
        n = self.size + 1
        ok = np.ones(len(a), bool)
        left, right = a.copy(), b.copy()
        end_l, end_r = np.full(len(a), FAR), np.full(len(a), FAR)
        live = np.arange(len(a))
        while len(live):
            x, y = left[live], right[live]
            key = x * n + y
            r = _rank_of(key, self.pair, self.pair_rank)
            bad = (r < end_l[live]) & (r <= end_r[live]) & (r < FAR)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_l = rx > ry
            go = ~bad & ((rx >= 0) | (ry >= 0))
            i, j = live[go & undo_l], live[go & ~undo_l]
            end_l[i], left[i] = self.rank[left[i]], self.right[left[i]]
            end_r[j], right[j] = self.rank[right[j]], self.left[right[j]]
            live = live[go]
        return ok


def dense(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a text in order, and the text as their numbers from 1 on."""
    names, inverse = np.unique(text, return_inverse=True)
    return names, inverse.astype(np.int64) + 1


def four(text: np.ndarray, bits: int) -> np.ndarray:
    """Four symbols from each place on as one number; 0 beyond the end."""
    padded = np.concatenate([text, np.zeros(3, np.int64)]).astype(np.uint64)
    n = len(text)
    return (padded[:n] << np.uint64(3 * bits)) | (padded[1 : n + 1] << np.uint64(2 * bits)) | (padded[2 : n + 2] << np.uint64(bits)) | padded[3 : n + 3]


def suffix_array(key: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling from keys of four symbols."""
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    k = 4
    while k < depth:
        both = rank * (len(key) + 1)
        both[:-k] += rank[k:] + 1
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


def ranges(text: np.ndarray, key: np.ndarray, order: np.ndarray, chars: np.ndarray, length: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``chars`` the range of ``order`` whose suffixes begin with its first ``length`` symbols: binary
    search by the first four symbols at once, then, inside these ranges, symbol by symbol."""
    ordered = key[order]
    head = np.zeros(len(chars), np.uint64)
    for j in range(4):
        head |= np.where(length > j, chars[:, j], 0).astype(np.uint64) << np.uint64((3 - j) * bits)
    span = np.uint64(1) << (np.uint64(bits) * (4 - np.minimum(length, 4)).astype(np.uint64))
    lo, hi = np.searchsorted(ordered, head), np.searchsorted(ordered, head + span)
    more = np.flatnonzero((length > 4) & (lo < hi))
    padded = np.concatenate([text, np.full(chars.shape[1], -1)])
    edges = []
    for upper in (False, True):
        a, z = lo[more], hi[more]
        live = np.arange(len(more))
        while len(live):
            mid = (a[live] + z[live]) // 2
            at, of = order[mid], more[live]
            less = np.zeros(len(live), bool)
            same = np.ones(len(live), bool)
            for j in range(4, chars.shape[1]):
                rest = same & (j < length[of])
                if not rest.any():
                    break
                have, want = padded[at + j], chars[of, j]
                less |= rest & (have < want)
                same &= ~rest | (have == want)
            right = less | (same & upper)
            a[live[right]] = mid[right] + 1
            z[live[~right]] = mid[~right]
            live = live[a[live] < z[live]]
        edges.append(a)
    lo[more], hi[more] = edges
    return lo, hi


class Encoder:
    def __init__(self, path: str, kind: str = "bpe"):
        self.model = Model(path, kind)
        self.cut = re.compile(" *[^ ]+| +") if self.model.split_at_space else re.compile("(?s).+")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and their number for each."""
        m = self.model
        spelled = [u.replace(" ", SPACE) for u in units]
        n = np.fromiter(map(len, spelled), np.int64, len(spelled))
        text = np.frombuffer("".join(s + "\0" for s in spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        first = np.cumsum(n + 1) - (n + 1)
        text[first + n] = 0  # the separator; a NUL of the text is 1
        names, coded = dense(text)
        if len(names) >= 1 << BITS:  # too many different characters for the keys
            half = len(units) // 2
            both = [self._segment(x) for x in (units[:half], units[half:])] if half else [self._alone(units[0])]
            return tuple(np.concatenate(x) for x in zip(*both, strict=True))
        start, piece, size = self._edges(names, coded, text == 0)
        unit = np.repeat(np.arange(len(n)), n + 1)
        by_hand = np.zeros(len(n), bool)
        if m.kind == "bpe":
            odd = np.isin(piece, list(m.odd))
            by_hand[unit[start[odd]]] = True
            live = ~m.dead[piece] & ~odd
            start, piece, size = start[live], piece[live], size[live]
        end = start + size
        column_ = end - first[unit[start]]
        # numbers of 16 bits are sorted by radix
        turn = np.argsort(column_.astype(np.uint16) if n.max(initial=0) < 1 << 16 else column_, kind="stable")
        del size, unit
        start, piece, end, column_ = start[turn], piece[turn], end[turn], column_[turn]
        steps = np.searchsorted(column_, np.arange(1, (column_[-1] if len(column_) else 0) + 2))
        last = np.full(len(text) + 1, -1, np.int64)  # of the piece that ends before a position
        back = np.zeros(len(text) + 1, np.int64)
        begins = np.zeros(len(text) + 1, bool)
        begins[first] = True
        best = np.full(len(text) + 1, -np.inf)
        best[first] = 0
        score = np.append(m.scores, m.scores.min() - 10)
        for a, z in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            s, p, e = start[a:z], piece[a:z], end[a:z]
            if m.kind == "bpe":
                ok = begins[s] | (last[s] >= 0)
                ok[ok] = begins[s[ok]] | m.stable(np.maximum(last[s[ok]], 0), p[ok])
                last[e[ok]], back[e[ok]] = p[ok], s[ok]
            else:
                total = best[s] + score[p]
                up = np.lexsort((total, e))
                last[e[up]], back[e[up]], best[e[up]] = p[up], s[up], total[up]  # the largest is written last
        at, ids, of = first + n, [], []
        live = np.flatnonzero(~by_hand & (n > 0))
        while len(live):
            ids.append(last[at[live]])
            of.append(live)
            at[live] = back[at[live]]
            live = live[at[live] > first[live]]
        ids_, of_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, of))
        step = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        place = np.lexsort((-step, of_))
        ids_, of_ = ids_[place], of_[place]
        lost = np.flatnonzero(ids_ == m.size)
        if len(lost):  # unknown characters become bytes
            width = m.width[ids_]
            before = np.cumsum(width) - width
            char = text[first[of_[lost]] + before[lost] - np.repeat(*self._runs(of_, before))[lost]] - 1
            kinds, which = np.unique(char, return_inverse=True)
            spelled_ = [self._bytes(chr(c)) for c in kinds.tolist()]
            many = np.ones(len(ids_), np.int64)
            many[lost] = np.array(list(map(len, spelled_)))[which]
            at = np.cumsum(many) - many
            ids_, of_ = np.repeat(ids_, many), np.repeat(of_, many)
            ids_[ragged(at[lost], many[lost])] = np.array([i for k in which.tolist() for i in spelled_[k]], np.int64)
        hand = {u: self._by_hand(spelled[u]) for u in np.flatnonzero(by_hand).tolist()}
        if hand:
            ids_ = np.concatenate([ids_, np.array([i for x in hand.values() for i in x], np.int64)])
            of_ = np.concatenate([of_, np.repeat(list(hand), [len(x) for x in hand.values()])])
            place = np.argsort(of_, kind="stable")
            ids_, of_ = ids_[place], of_[place]
        return ids_, np.bincount(of_, minlength=len(n))

    @staticmethod
    def _runs(of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at the start of each run of equal numbers, and the runs' lengths."""
        new = np.flatnonzero(np.diff(of, prepend=-1))
        return value[new], np.diff(np.append(new, len(of)))

    def _bytes(self, char: str) -> list[int]:
        return [self.model.bytes[b] for b in char.encode("utf-8", "replace")] if self.model.bytes else [self.model.unknown]

    def _by_hand(self, unit: str) -> list[int]:
        out, at = [], 0
        for i in self.model.merge(unit):
            if i == self.model.size:
                out += self._bytes(unit[at])
                at += 1
            else:
                out.append(i)
                at += len(self.model.pieces[i])
        return out

    def _alone(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a unit too long for the graph of a batch: windows of its text are indexed one after another, an edge is of
        the window where it starts, and edges are relaxed from the first place on."""
        m = self.model
        spelled = unit.replace(" ", SPACE)
        text = np.frombuffer(spelled.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        n, longest = len(text), m.chars.shape[1]
        last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int64)
        best = np.full(n + 1, -np.inf)
        best[0] = 0
        score = np.append(m.scores, m.scores.min() - 10)
        fits: dict[tuple[int, int], bool] = {}
        for a in range(0, n, WINDOW):
            here = text[a : a + WINDOW + longest - 1]
            start, piece, size = self._edges(*dense(here), np.zeros(len(here), bool))
            own = start < WINDOW
            start, piece, size = start[own], piece[own], size[own]
            if m.kind == "bpe":
                if np.isin(piece, list(m.odd)).any():
                    ids = self._by_hand(spelled)
                    return np.array(ids, np.int64), np.array([len(ids)])
                live = ~m.dead[piece]
                start, piece, size = start[live], piece[live], size[live]
            turn = np.argsort(start, kind="stable")
            start, piece, size = start[turn] + a, piece[turn], size[turn]
            if m.kind == "bpe":
                self._seams(start, piece, size, last, a, fits)
            for s, p, e in zip(start.tolist(), piece.tolist(), (start + size).tolist(), strict=True):
                before = int(last[s])
                if s and before < 0:
                    continue
                if m.kind == "bpe":
                    if s and not fits[before, p]:
                        continue
                elif best[s] + score[p] <= best[e]:
                    continue
                else:
                    best[e] = best[s] + score[p]
                last[e], back[e] = p, s
        ids, at = [], n
        while at:
            p = int(last[at])
            ids.append([p] if p != m.size else self._bytes(spelled[at - 1]))
            at = int(back[at])
        out = np.array([i for x in reversed(ids) for i in x], np.int64)
        return out, np.array([len(out)])

    def _seams(self, start: np.ndarray, piece: np.ndarray, size: np.ndarray, last: np.ndarray, a: int, fits: dict[tuple[int, int], bool]) -> None:
        """Whether pieces fit behind each other, for all pairs of edges that meet: edges that end where others begin, or
        that came into the window from the one before."""
        end = start + size
        turn = np.argsort(end, kind="stable")
        ends, by_end = end[turn], piece[turn]
        lo, hi = np.searchsorted(ends, start, "left"), np.searchsorted(ends, start, "right")
        left, right = by_end[ragged(lo, hi - lo)], np.repeat(piece, hi - lo)
        into = np.flatnonzero((start < a + self.model.chars.shape[1]) & (last[start] >= 0))
        key = np.unique(np.concatenate([left * FAR + right, last[start[into]].astype(np.int64) * FAR + piece[into]]))
        pairs = [k for k in zip((key // FAR).tolist(), (key % FAR).tolist(), strict=True) if k not in fits]
        if pairs:
            x, y = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
            fits.update(zip(pairs, self.model.stable(x, y).tolist(), strict=True))

    def _edges(self, names: np.ndarray, coded: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces in a text (start, piece, size); a character that is no piece is one of its own, but for
        ``gaps``."""
        m = self.model
        # pieces with a character that the text lacks have no place in it
        own = np.minimum(np.searchsorted(names, m.chars + 1), len(names) - 1)
        fit = ((names[own] == m.chars + 1) | (m.chars == 0)).all(1)
        pieces, chars, length = m.ids[fit], np.where(m.chars[fit] > 0, own[fit] + 1, 0), m.length[fit]
        key = four(coded, BITS)
        order = suffix_array(key, m.chars.shape[1])
        lo, hi = ranges(coded, key, order, chars, length, BITS)
        start, piece, size = order[ragged(lo, hi - lo)], np.repeat(pieces, hi - lo), np.repeat(length, hi - lo)
        known = gaps.copy()
        known[start[size == 1]] = True
        lone = np.flatnonzero(~known)
        return np.concatenate([start, lone]), np.concatenate([piece, np.full(len(lone), m.size)]), np.concatenate([size, np.ones(len(lone), np.int64)])

    def _learn(self, units: list[str]) -> None:
        # a longer unit stands alone; its graph would not fit
        ids, n = self._alone(units[0]) if len(units[0]) > BATCH_CHARS else self._segment(units)
        first = len(self.place)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.n, self.flat = np.concatenate([self.n, n.astype(np.int32)]), np.concatenate([self.flat, ids.astype(np.int32)])
        self.place.update(zip(units, range(first, first + len(units)), strict=True))

    def _units(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the number of each unit of the texts among them, and units per text."""
        fast = np.zeros(len(texts), bool)
        units: list[str] = []
        codes, count = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if self.model.plain and self.model.split_at_space:
            # where each word has one space before it and no other stands, the words are the units
            said = pa.array([(t or "").replace(SPACE, " ") for t in texts], pa.string())
            odd = pc.or_(pc.match_substring(said, "  "), pc.or_(pc.starts_with(said, " "), pc.ends_with(said, " ")))
            fast = ~odd.to_numpy(zero_copy_only=False) & pc.not_equal(said, "").to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(said.filter(pa.array(fast)), " ")
            coded = lists.flatten().dictionary_encode()
            units = [f" {w}" for w in coded.dictionary.to_pylist()]
            codes, count[fast] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy()
        numbers: dict[str, int] = {}
        slow: list[int] = []
        for k in np.flatnonzero(~fast).tolist():
            t = texts[k] or ""
            if not self.model.plain:
                t = self.model.library.normalize(t).replace(SPACE, " ")
            elif t:
                t = " " + t.replace(SPACE, " ")
            own = self.cut.findall(t)
            count[k] = len(own)
            slow += [numbers.setdefault(u, len(units) + len(numbers)) for u in own]
        out = np.zeros(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        out[ragged(first[fast], count[fast])] = codes
        out[ragged(first[~fast], count[~fast])] = slow
        return units + list(numbers), out, count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number for each."""
        if len(self.place) > CACHE_UNITS:
            self._clear()
        units, codes, count = self._units(texts)
        part, size = [], 0
        for u in dict.fromkeys(units):
            if u not in self.place:
                if part and size + len(u) > BATCH_CHARS:
                    self._learn(part)
                    part, size = [], 0
                part.append(u)
                size += len(u) + 1
        if part:
            self._learn(part)
        place = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))[codes]
        n = self.n[place].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        return self.flat[ragged(self.at[place], n)], np.diff(before[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])])

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.model.out.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_open: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """A worker keeps the encoder that it has opened."""
    if (path, kind) not in _open:
        _open.clear()
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe", ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip, ids) for each row of ``docs`` (doc_id, text); ids_crc32
    is over little-endian unsigned 32-bit ids, decoded_sha256 over the text that the ids decode to. Without ``ids`` that
    column is left out."""
    small_batches(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, kind)
        for t in tables(batches, limit=2 << 20):
            texts = column(t, "text").to_pylist()
            flat, n = e.encode(texts)
            z = np.cumsum(n)
            raw = flat.astype("<u4")
            crc, sha, same = [], [], []
            for text, a, b in zip(texts, (z - n).tolist(), z.tolist(), strict=True):
                crc.append(zlib.crc32(raw[a:b].tobytes()))
                back = e.decode(flat[a:b].tolist())
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (text or ""))
            rows = [column(t, "doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
            if ids:
                rows.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], z]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield from pa.table(rows, names).to_batches(max_chunksize=1024)
            del rows, raw, flat, texts, t
        trim()

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over, schema)


def decode(rows: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids)."""
    small_batches(rows.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, kind)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else e.decode(x) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(over, "doc_id long, text string")
