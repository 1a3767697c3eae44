"""Packing of documents into sequences with the least slack a window can have.

A document is its token ids (by the ``tokenizers`` library) and END. Its full
windows of SIZE ids are sequences of their own; what is left (1 to SIZE - 1 ids)
is a rest. Rests are dealt at random, by a hash of their place, into groups of
about GROUP documents, so a group's memory is bounded and no key is hot.

In a group the remaining lengths are a multiset. A window takes the longest rest;
a subset-sum over the others (one bitset of reachable sums, counts in binary
parts, lengths descending) gives the sum closest to what is free, and the
backtracked counts say how many rests of each length make it. The same pattern
is used as often as the counts allow. If the closest sum leaves a gap, the front
of the longest rest left fills it and the remainder goes back to the multiset.
Only the last rests of a group do not fill a window: they are cut into sequences
whose lengths are powers of two, which need no padding.

Null text counts as empty: END alone. A null id stays null; repeated rows are
packed as often as they occur; equal lengths are taken in the order of the rows.
Other columns are not looked at; an empty table gives an empty result. Which
texts share a sequence depends on how Spark splits the input; that every id lies
in one piece, gapless, does not.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuescope.llm.bpe import in_parts

SIZE, GROUP, END = 2048, 2048, 1
#: Bytes of words that a task holds, and the longest word held.
HELD, LONG = 1 << 28, 64
SPACES = "\t\n\x0b\x0c\r "
#: Latin letters that have one lower-case letter, then ASCII marks.
LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int]  # (index of the rest, first id, number of ids)


def closest(lengths: list[int], count: Callable[[int], int], free: int) -> dict[int, int]:
    """How many of each of the ascending ``lengths`` make the largest sum of at most ``free``; ``count`` bounds them."""
    reach, mask, steps = 1, (1 << (free + 1)) - 1, []
    for k in reversed(range(bisect.bisect_right(lengths, free))):
        length = lengths[k]
        left, part = min(count(length), free // length), 1
        while left and not reach >> free & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (part * length)) & mask
            left, part = left - part, 2 * part
        if reach >> free & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= part * length
    return used


def cut_to_powers(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """The pieces in order, cut into sequences whose lengths are the powers of two of their sum (the largest first)."""
    total, out = sum(p[2] for p in pieces), []
    rest = pieces[::-1]
    while total:
        room = min(1 << (total.bit_length() - 1), 1 << (size.bit_length() - 1))
        total -= room
        out.append([])
        while room:
            k, at, n = rest.pop()
            if n > room:
                rest.append((k, at + room, n - room))
                n = room
            out[-1].append((k, at, n))
            room -= n
    return out


def windows(lengths: list[int], size: int = SIZE) -> Iterator[list[Piece]]:
    """Sequences of pieces of rests (each of 1 to ``size`` ids): every id in one piece."""
    held: dict[int, list[tuple[int, int]]] = {}
    for k in reversed(range(len(lengths))):
        held.setdefault(lengths[k], []).append((k, 0))
    order = sorted(held)

    def pop(n: int) -> Piece:
        k, at = held[n].pop()
        if not held[n]:
            del held[n], order[bisect.bisect_left(order, n)]
        return k, at, n

    while held:
        first = order[-1]
        used = closest(order, lambda n: len(held[n]) - (n == first), size - first)  # noqa: B023
        used[first] = used.get(first, 0) + 1
        gap = size - sum(n * c for n, c in used.items())
        if not gap:
            for _ in range(min(len(held[n]) // c for n, c in used.items())):
                yield [pop(n) for n, c in used.items() for _ in range(c)]
            continue
        row = [pop(n) for n, c in used.items() for _ in range(c)]
        if held:  # every rest left is longer than the gap, else the sum would be larger
            k, at, n = pop(order[-1])
            row.append((k, at, gap))
            if n - gap not in held:
                bisect.insort(order, n - gap)
            held.setdefault(n - gap, []).append((k, at + gap))
            yield row
        else:
            yield from cut_to_powers(row, size)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
#: A byte that begins a character from U+0300 on, where the combining marks are.
WIDE = re.compile(rb"[\xcc-\xff]")


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: a byte that is a visible Latin-1 character stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in own else 256 + sum(c not in own for c in range(b)) for b in range(256)}


BYTES = byte_letters()


class Ids:
    """Ids of whole texts as bytes. Where the model drops ASCII white space, the library encodes each distinct word once.

    A word of Latin letters and marks behind them goes by its parts, its letters (lower case, as bytes) straight to
    the library's merges. Both are tried when the model is read, on a probe with each space between words, marks,
    digits and special tokens, and on words of each Latin letter; a model that answers otherwise gets whole texts or
    whole words. The words held are bounded by their bytes; words beyond LONG bytes are not held.
    """

    def __init__(self, path: str):
        self.t, self.kind, self.held, self.parts, self.size = tokenizer(path), id_type(path), {}, {}, 0
        words = ["a", "B's", "'", "s", "7", "...", "\u0301e", "\u00c9", "\U0001f642", *(a.content for a in self.t.get_added_tokens_decoder().values())]
        probe = [f"{v}{s}{w}" for v in words for w in words for s in (*SPACES, "  ", " \n")]
        self.apart = all(self.plain(x) == self.plain(x.split(None, 1)[0]) + self.plain(x.split(None, 1)[1]) for x in probe)
        letters = [chr(c) for c in range(33, 0x180) if LATIN.fullmatch(chr(c))]
        probe = [v for c in letters for v in (c, f"x{c}", f"{c}AN{c}", f"{c}e.", f"{c}'", f"{c}ed?!")]
        self.latin = self.apart and self.by_parts([w.encode() for w in probe]) == {w.encode(): self.array(self.plain(w)) for w in probe}
        self.special = [a.content.lower().encode() for a in self.t.get_added_tokens_decoder().values()]

    def array(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def plain(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def library(self, texts: list[str]) -> list[bytes]:
        return [self.array(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def by_parts(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the words that are Latin letters and marks; other words are left out."""
        out, get = {}, self.parts.get
        for w in words:
            m = LATIN.fullmatch(w.decode())
            if not m:
                continue
            letters, marks = m.groups()
            ids = get(letters)
            if ids is None:
                low = letters.lower()
                raw = low if low.isascii() else low.encode().decode("latin-1").translate(BYTES)
                ids = self.parts[letters] = self.array([x.id for x in self.t.model.tokenize(raw)])
            if marks:
                end = get(marks)
                if end is None:
                    end = self.parts[marks] = self.array(self.plain(marks))
                ids += end
            out[w] = ids
        return out

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = self.by_parts(words) if self.latin else {}
        rest = [w for w in words if w not in out] if len(out) < len(words) else []
        out.update(zip(rest, self.library([w.decode() for w in rest]), strict=True))
        return out

    def cut(self, text: str) -> list[bytes]:
        """Words; A-Z in lower case where that changes no id: without combining marks, and not where it makes a special token."""
        raw = text.encode()
        if self.latin and not WIDE.search(raw):
            low = raw.lower()
            if not any(x in low for x in self.special):
                raw = low
        return raw.split()

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self.library(texts)
        cut = [self.cut(t) for t in texts]
        if self.size > HELD:
            self.held, self.parts, self.size = {}, {}, 0
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.held))
        self.held |= self.words(new)
        out = [b"".join(map(self.held.__getitem__, ws)) for ws in cut]
        if max(map(len, new), default=0) > LONG:
            for w in new:
                if len(w) > LONG:
                    del self.held[w]
        self.size += 400 * len(new)  # measured: a word of up to LONG bytes, its ids, and its parts
        return out


@functools.cache
def ids_of(path: str) -> Ids:
    """One for a Python worker, which serves many tasks."""
    return Ids(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """Full windows (crc, no ids) and rests (ids): doc_id, doc_tokens, start, length, ids_crc32, key, ids."""
    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "key", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key = ids_of(path), TaskContext.get().partitionId() << 32
        for b in batches:
            for part in in_parts(zip(b.column(0).to_pylist(), (s or "" for s in b.column(1).to_pylist()), strict=True)):
                out = []
                end = np.array([END], model.kind).tobytes()
                for (doc_id, _), got in zip(part, model.of([s for _, s in part]), strict=True):
                    ids = np.frombuffer(got + end, model.kind)
                    n = len(ids)
                    for at in range(0, n, size):
                        some = ids[at:at + size]
                        full = len(some) == size
                        out.append((doc_id, n, at, len(some), crc(some) if full else None, key, None if full else some.tobytes()))
                        key += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*out), strict=True)], names=names)

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names))


def pack(docs: DataFrame, path: str, size: int = SIZE, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group))
    kind = id_type(path)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows[rows["ids"].isna()]
        out = [(*r, 0) for r in zip(whole["doc_id"], whole["start"], whole["length"], whole["ids_crc32"], whole["doc_tokens"],
                                    2 * whole["key"] + 1, strict=True)]
        part = rows[rows["ids"].notna()].sort_values("key")
        ids, ends = [np.frombuffer(x, kind) for x in part["ids"]], list(zip(part["doc_id"], part["start"], part["doc_tokens"], strict=True))
        for n, row in enumerate(windows([len(x) for x in ids], size)):
            at = 0
            for k, lo, length in row:
                doc_id, start, doc_tokens = ends[k]
                out.append((doc_id, start + lo, length, crc(ids[k][lo:lo + length]), doc_tokens, 2 * (key[0] << 24 | n), at))
                at += length
        got = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        return got.astype({c: "Int64" for c in got.columns})

    pieces = cut(docs, path, size, id_col, text_col)
    return pieces.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("g").applyInPandas(run, PIECES)
