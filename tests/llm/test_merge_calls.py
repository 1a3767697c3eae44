"""Rounds of merging ask for the ranks of both neighbours of the new symbols at once, and whole batches share the rounds."""

import numpy as np
import public_tokenizers
import pytest

from valuescope.llm import bpe, pieces
from valuescope.llm.queries import PIECES


@pytest.fixture()
def calls(monkeypatch):
    m, n, rank = bpe.model(public_tokenizers.path(PIECES)), [], bpe.Model.rank
    monkeypatch.setattr(bpe.Model, "rank", lambda self, a, b: n.append(np.size(a)) or rank(self, a, b))
    return m, n


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_a_round_asks_once_for_ranks(calls, rate):
    m, n = calls
    new = [f"{bpe.SPACE}{w}" for w in ("reading", "written", "network", "another", "zzzzzzz", "\x00\x00\x00\x00\x00\x00\x00")]
    keys = np.arange(len(new), dtype=np.uint64)
    rows = {int(k): s for at, sym in bpe.merge_units(m, new, keys, 5, rate) for k, s in zip(at, sym.tolist(), strict=True)}
    assert [rows[k] for k in range(len(new))] == [bpe.merge_one(m, m.symbols(u), np.uint64(k), 5, rate) for k, u in enumerate(new)]
    assert len(n) <= len(new[0])  # the first ranks, and one call for each of at most n - 1 rounds


def test_a_batch_of_rows_shares_its_rounds(spark, calls):
    rows = [(k, f"text{k % 7} of row") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert pieces.ROWS >= 600 and pieces.CHARS >= sum(len(t) for _, t in rows)
    got = {r["doc_id"]: r for r in pieces.encode(df, public_tokenizers.path(PIECES), rate=0.0).collect()}
    assert len(got) == 600 and all(r["lossless"] and list(r["ids"]) == calls[0].sp.encode(dict(rows)[k]) for k, r in got.items())
