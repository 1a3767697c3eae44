"""Merging of ragged symbol arrays by rank, shared by the token operators.

Texts are cut into units (a run of spaces with the characters after it, or a
line break): no vocabulary piece crosses such a cut, which is checked when the
model is read, so a text's pieces are the pieces of its units in order.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np

NONE = np.int64(1) << 40
LONG = 96
SPACE = "▁"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser used as keyed hash (constants of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte = np.zeros(256, np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(self.pieces[i][3:-1], 16)] = i
        self.chars = -1 - np.arange(0x110000, dtype=np.int64)  # as symbols(), for arrays of code points
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        crossing = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross word starts: {crossing[:5]}")
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = (order[sp.get_score(i)] << 32) | i
        self.pair = found
        self.bits = max(12, int(len(found) * 8).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)  # open addressing, see rank()
        self.vals = np.full(1 << self.bits, NONE << 22, np.int64)
        self.probes = 1
        for k, v in found.items():
            at, probe = self._slot(k), 1
            while self.slots[at] >= 0:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.slots[at], self.vals[at], self.probes = k, v, max(self.probes, probe)
        self.raw = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()
                    for i, p in enumerate(self.pieces)]

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(rank << 32 | merged id) of each pair, NONE << 22 where the pair has no piece."""
        key = (a << 32) | b  # negative where a symbol is, and no pair is; -1 finds free slots only, whose value is NONE << 22
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == key, self.vals[at], NONE << 22)
        open_ = np.nonzero((got != key) & (got >= 0))
        for k in range(1, self.probes):
            if not len(open_[0]):
                break
            to = (at[open_] + k) & ((1 << self.bits) - 1)
            got, want = self.slots[to], key[open_]
            hit = got == want
            out[tuple(o[hit] for o in open_)] = self.vals[to[hit]]
            go = (~hit) & (got >= 0)
            open_ = tuple(o[go] for o in open_)
        return out

    def symbols(self, unit: str) -> list[int]:
        """Ids of the characters; an unknown character is -1 - its code point."""
        get = self.ids.get
        return [i if (i := get(c)) is not None else -1 - ord(c) for c in unit]

    def spelled(self, syms) -> list[int]:
        """Unknown characters as their bytes."""
        out = []
        for s in syms:
            if s >= 0:
                out.append(s)
            else:
                out += self.byte[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def units(text: str, keep_mark: bool = False) -> list[str]:
    """Units of a text with the leading space that the model adds; none for an empty text."""
    return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def span(start, mid, end) -> np.ndarray:
    """A candidate merge [start, mid) + [mid, end) of a unit in one number."""
    return (np.asarray(start, np.uint64) << np.uint64(42)) ^ (np.asarray(mid, np.uint64) << np.uint64(21)) ^ np.asarray(end, np.uint64)


def skips(seed: int, key, spans: np.ndarray, rate: float):
    """Keyed hash decision for candidate merges."""
    with np.errstate(over="ignore"):
        x = mix(np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(key, np.uint64)) ^ spans
    return mix(x) < np.uint64(int(rate * (2**64 - 1)))


def skipped(seed: int, key, start, mid, end, rate: float):
    return skips(seed, key, span(start, mid, end), rate)


def dropped(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``x`` without column ``p[i]`` of each row i."""
    return np.where(np.arange(x.shape[1] - 1) < p[:, None], x[:, :-1], x[:, 1:])


def merge_block(m: Model, sym: np.ndarray, key=None, seed: int = 0, rate: float = 0.0, log: list | None = None):
    """Rank-synchronous merging of rows of equal length: (positions, symbols) of the rows as they end.

    In each round every row applies its lowest-rank (leftmost) pair and shrinks
    by one symbol; a row without a live candidate leaves. With ``rate`` a
    candidate enters the agenda as dead where its keyed hash says so. ``log``
    gets (rows, packed spans) of the merges of each round.
    """
    places = rate or log is not None
    n = sym.shape[1]
    at = np.arange(len(sym))
    start = np.broadcast_to(np.arange(n + 1), (len(at), n + 1)).copy() if places else None

    def ranked(r, c):
        """Ranks of the pairs at columns ``c`` of rows ``r``; only pairs that have a piece are asked for their skip."""
        got = m.rank(sym[r, c], sym[r, c + 1])
        if rate:
            is_ = np.nonzero(got < (NONE << 22))[0]
            r, c = r[is_], c[is_]
            got[is_[skipped(seed, key[r], start[r, c], start[r, c + 1], start[r, c + 2], rate)]] = NONE << 22
        return got

    if n > 1:
        rank = ranked(np.repeat(at, n - 1), np.tile(np.arange(n - 1), len(at))).reshape(-1, n - 1)
    while len(at) and (width := sym.shape[1]) > 1:
        p = rank.argmin(1)
        best = rank[np.arange(len(at)), p]
        live = best < (NONE << 22)
        if not live.all():
            yield at[~live], sym[~live]
            at, sym, rank, p, best = at[live], sym[live], rank[live], p[live], best[live]
            start = start[live] if places else None
            key = key[live] if rate else None
        row = np.arange(len(at))
        if log is not None and len(at):
            log.append((at, span(start[row, p], start[row, p + 1], start[row, p + 2])))
        sym[row, p] = best & 0xFFFFFFFF
        sym, rank = dropped(sym, p + 1), dropped(rank, p)
        start = dropped(start, p + 1) if places else None
        row, q = np.concatenate([row, row]), np.concatenate([p - 1, p])  # the pairs left and right of the new symbol
        ok = (q >= 0) & (q + 1 < width - 1)
        r, c = row[ok], q[ok]
        if len(r):
            rank[r, c] = ranked(r, c)
    if len(at):
        yield at, sym


def merge_units(m: Model, new: list[str], keys=None, seed: int = 0, rate: float = 0.0, log: list | None = None):
    """(places in ``new``, their symbols as a matrix) for all units, grouped by length; long ones go one by one.

    ``log`` gets (places, packed spans) of the merges, but for the long ones.
    """
    lengths = np.fromiter(map(len, new), np.int64, len(new))
    order = np.argsort(lengths, kind="stable")
    cuts = np.nonzero(np.diff(lengths[order]))[0] + 1
    if rate:
        keys = np.asarray(keys, np.uint64)
    for at in np.split(order, cuts) if len(new) else []:
        n, which = int(lengths[at[0]]), at.tolist()
        if n > LONG:
            for k in which:
                yield np.array([k]), np.array([merge_one(m, m.symbols(new[k]), None if keys is None else keys[k], seed, rate)], np.int64)
            continue
        chars = np.frombuffer("".join(map(new.__getitem__, which)).encode("utf-32-le", "surrogatepass"), np.uint32)
        key = keys[at] if rate else None
        done = None if log is None else []
        for where, sym in merge_block(m, m.chars[chars].reshape(-1, n), key, seed, rate, done):
            yield at[where], sym
        if log is not None:
            log += [(at[where], spans) for where, spans in done]


def merge_rows(m: Model, rows: list[list[int]], keys=None, seed: int = 0, rate: float = 0.0) -> list[list[int]]:
    """The merged symbols of ragged rows; rows of equal length are merged as one block, long ones one by one."""
    out: list = [None] * len(rows)
    by: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        if len(r) > LONG:
            out[k] = merge_one(m, r, None if keys is None else keys[k], seed, rate)
        else:
            by.setdefault(len(r), []).append(k)
    for which in by.values():
        key = np.array([keys[k] for k in which], np.uint64) if rate else None
        for where, sym in merge_block(m, np.array([rows[k] for k in which], np.int64), key, seed, rate):
            for k, s in zip(where.tolist(), sym.tolist(), strict=True):
                out[which[k]] = s
    return out


def merge_one(m: Model, syms: list[int], key=None, seed: int = 0, rate: float = 0.0) -> list[int]:
    """The same result for one long row with a heap agenda, n log n."""
    n = len(syms)
    sym, nxt, prv = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list = []

    def add(i: int, j: int, stop: int) -> None:
        a, b = sym[i], sym[j]
        if a >= 0 and b >= 0 and (v := m.pair.get((a << 32) | b)) is not None and not (rate and bool(skipped(seed, key, i, j, stop, rate))):
            heapq.heappush(heap, (v >> 32, i, j, a, b, v & 0xFFFFFFFF))

    for i in range(n - 1):
        add(i, i + 1, i + 2)
    while heap:
        _, i, j, a, b, v = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and nxt[i] == j and sym[i] == a and sym[j] == b):
            continue
        sym[i], alive[j], nxt[i] = v, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            add(prv[i], i, nxt[i])
        if nxt[i] < n:
            add(i, nxt[i], nxt[nxt[i]])
    return [s for s, a in zip(sym, alive, strict=True) if a]


def in_parts(texts, chars: int = 1 << 20):
    """Consecutive runs of whole texts of about ``chars`` characters: bounds the memory of a batch."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t[1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
