"""SentencePiece encoding with seeded merge-dropout, and decoding.

Every candidate merge of a unit (see ``bpe``) enters the agenda once, when its
two symbols become neighbours. A keyed hash of (seed, document id, place of the
unit in the text, span of the merge) decides whether it is skipped, so each
occurrence draws its own skips; the agenda is processed in rank order, for many
occurrences at once. A worker keeps each unit's plain ids and the merges that
lead to them: an occurrence that skips none of these has the plain ids, only the
others are merged anew. With rate 0 the ids are those of the library.

Decoding joins the pieces' bytes and removes the added space: any ids that this
encoder gives decode to the text exactly. A space mark that stands in the text
itself is spelled in bytes, so it is kept apart from a space.

Null and empty texts give no ids. A null id counts as 0 in the hash; repeated
rows get equal ids. Other columns are not looked at. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from valuescope.llm import bpe

SEED, RATE = 17, 0.1
CACHE = 400_000
ROWS, CHARS = 1000, 1 << 22  # of a batch that are encoded at once: the more occurrences a round merges, the fewer calls
MARK = "\udfff"  # stands for a space mark of the text while it is cut; no valid text holds it
SCHEMA = "doc_id long, ids array<int>, n_ids long, n_bytes long, lossless boolean"


def cut(text: str) -> list[str]:
    return bpe.units(text.replace(bpe.SPACE, MARK) if bpe.SPACE in text else text)


def ids_of(m: bpe.Model, new: list[str], keys=None, seed: int = 0, rate: float = 0.0, log: list | None = None) -> list[bytes]:
    out = [b""] * len(new)
    for at, sym in bpe.merge_units(m, new, keys, seed, rate, log):
        flat, width, odd = sym.astype(np.int32).tobytes(), 4 * sym.shape[1], (sym < 0).any(1)
        for j, (k, o) in enumerate(zip(at.tolist(), odd.tolist(), strict=True)):
            out[k] = spelled(m, sym[j].tolist()) if o else flat[j * width:(j + 1) * width]
    return out


class Plain:
    """Units with their plain ids and the spans of the merges on the way there."""

    def __init__(self, m: bpe.Model):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.first, self.n, self.long = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.spans = np.empty(0, np.uint64)

    def add(self, new: list[str]) -> None:
        log: list = []
        self.at.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.ids += ids_of(self.m, new, log=log)
        where = np.concatenate([np.empty(0, np.int64), *(w for w, _ in log)])
        n = np.bincount(where, minlength=len(new))
        self.first = np.concatenate([self.first, len(self.spans) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.long = np.concatenate([self.long, [len(u) > bpe.LONG for u in new]]).astype(bool)
        self.spans = np.concatenate([self.spans, np.concatenate([np.empty(0, np.uint64), *(x for _, x in log)])[np.argsort(where, kind="stable")]])

    def varies(self, at: np.ndarray, keys: np.ndarray, seed: int, rate: float) -> np.ndarray:
        """Whether each occurrence of the units ``at`` skips a merge of its plain way (long units: always asked anew)."""
        n, out = self.n[at], self.long[at] & (rate > 0)
        row = np.repeat(np.arange(len(at)), n)
        spans = self.spans[np.arange(len(row)) + np.repeat(self.first[at] - np.cumsum(n) + n, n)]
        out[row[bpe.skips(seed, keys[row], spans, rate)]] = True
        return out


def spelled(m: bpe.Model, syms: list[int]) -> bytes:
    """Ids of a row with unknown characters, which are spelled in bytes."""
    flat = []
    for s in syms:
        flat += m.byte[list(bpe.SPACE.encode())].tolist() if s == -1 - ord(MARK) else m.spelled([s])
    return np.array(flat, np.int32).tobytes()


def keys_of(doc_id: int | None, n: int, seed: int) -> np.ndarray:
    """A key for each of the ``n`` units of a text."""
    with np.errstate(over="ignore"):
        return bpe.mix(np.arange(n, dtype=np.uint64) + np.uint64((doc_id or 0) & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def decode(m: bpe.Model, ids) -> str:
    """The text of ids made by ``encode``."""
    return b"".join(map(m.raw.__getitem__, ids))[1:].decode()


def encode(docs: DataFrame, path: str, seed: int = SEED, rate: float = RATE,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, n_bytes, lossless (the ids, decoded, are the text): one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(path)
        plain = Plain(m)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                s = b.slice(lo, ROWS)
                rows = list(zip(s.column(0).to_pylist(), [t or "" for t in s.column(1).to_pylist()], strict=True))
                for part in bpe.in_parts(rows, CHARS):
                    units = [cut(t) for _, t in part]
                    if len(plain.at) > CACHE:
                        plain.clear()
                    plain.add(list(set().union(*units).difference(plain.at)))
                    every = [u for us in units for u in us]
                    at = np.fromiter(map(plain.at.__getitem__, every), np.int64, len(every))
                    keys = np.concatenate([keys_of(i, len(us), seed) for (i, _), us in zip(part, units, strict=True)])
                    anew = np.nonzero(plain.varies(at, keys, seed, rate))[0]
                    pieces = list(map(plain.ids.__getitem__, at.tolist()))
                    for k, x in zip(anew.tolist(), ids_of(m, [every[k] for k in anew.tolist()], keys[anew], seed, rate), strict=True):
                        pieces[k] = x
                    ends = np.cumsum([0, *map(len, units)]).tolist()
                    got = [b"".join(pieces[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]
                    ids = [np.frombuffer(g, np.int32) for g in got]
                    raw = [t.encode() for _, t in part]
                    same = [b"".join(map(m.raw.__getitem__, x.tolist()))[1:] == r for x, r in zip(ids, raw, strict=True)]
                    at = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat),
                         pa.array([len(x) for x in ids], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())],
                        names=["doc_id", "ids", "n_ids", "n_bytes", "lossless"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
