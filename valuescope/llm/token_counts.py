"""Token counts of whole texts by rank-synchronous array merging.

Unseen units of a run of texts are held as arrays grouped by length; every
array applies the lowest-rank pair of each of its rows at once, round by round,
and the surviving symbols are counted (an unknown character counts as its
bytes). Counts equal those of the library that owns the model.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are
returned as they are; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from valuescope.llm import bpe

LIMIT = 4096
CACHE = 1_000_000


def counts_of(m: bpe.Model, new: list[str]) -> list[int]:
    rows = [m.symbols(u) for u in new]
    return [len(r) if min(r) >= 0 else len(m.spelled(r)) for r in bpe.merge_rows(m, rows)]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit. No shuffle; memory is bounded by a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = bpe.model(path), {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                n_bytes, n_tokens = [], []
                for part in bpe.in_parts((None, t or "") for t in s.column(1).to_pylist()):
                    cut = [bpe.units(t) for _, t in part]
                    if len(seen) > CACHE:
                        seen.clear()
                    new = list({u for us in cut for u in us if u not in seen})
                    seen.update(zip(new, counts_of(m, new), strict=True))
                    get = seen.__getitem__
                    n_tokens += [sum(map(get, us)) for us in cut]
                    n_bytes += [len(t.encode()) for _, t in part]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                                  pa.array([n > limit for n in n_tokens], pa.bool_())],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
