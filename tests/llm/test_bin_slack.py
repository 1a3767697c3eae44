"""Minimum bin slack packing: subset sums against all subsets, and an exact round trip of ids."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from valuescope.llm import bin_slack

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(1, 40))
def test_closest_is_the_best_subset_sum(lengths, free):
    counts = {n: lengths.count(n) for n in lengths}
    used = bin_slack.closest(sorted(counts), counts.get, free)
    assert all(0 < c <= counts[n] for n, c in used.items())
    best = max(sum(s) for k in range(len(lengths) + 1) for s in itertools.combinations(lengths, k) if sum(s) <= free)
    assert sum(n * c for n, c in used.items()) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.sampled_from([16, 20]))
def test_windows_hold_every_id_once_without_padding(lengths, size):
    rows = list(bin_slack.windows(lengths, size))
    held = sorted((k, at, n) for row in rows for k, at, n in row)
    for k, n in enumerate(lengths):
        ends = [(at, at + m) for i, at, m in held if i == k]
        assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    sums = [sum(n for _, _, n in row) for row in rows]
    assert all(n == size or n & (n - 1) == 0 for n in sums) and all(n <= size for n in sums)
    assert len(rows) <= sum(lengths) // size + 1 + size.bit_length()


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["", None, "a", "  two   words\n", "the quick brown fox " * 1500, "the quick brown fox " * 1500, "<|endoftext|> x", "日本語 🙂 Éa",
         "x " * 2047, "x " * 2046, "word " * 700, "word " * 701, "word " * 900]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ É\u0301é'sS.7 \t\n\x0b\x0c\r\x1c\x85\u00a0\u2000Σσ日🙂<|endoftext|>İ¶"), max_size=40), max_size=6))
def test_ids_of_words_are_those_of_the_text(texts):
    model = IDS
    assert model.apart and model.latin
    texts = [*texts, "<|endoftext|> <|startoftext|>x H\u0331 " + "".join(texts), "A <|ENDOFTEXT|> Bc", "x" * 99]
    for _ in range(2):
        assert [np.frombuffer(x, model.kind).tolist() for x in model.of(texts)] == [model.plain(t) for t in texts]


IDS = bin_slack.Ids(PATH)


def test_other_models_encode_whole_texts():
    model = bin_slack.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert not model.apart
    assert [np.frombuffer(x, model.kind).tolist() for x in model.of(["a b  c", ""])] == [model.plain("a b  c"), []]


@pytest.mark.parametrize("size,group", [(2048, 2048), (64, 4)])
def test_pack_round_trip(spark, size, group):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0, "y"), (None, "no id here", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(3)
    got = bin_slack.pack(docs, PATH, size, group)
    assert got.columns == [c.split()[0] for c in bin_slack.PIECES.split(", ")]
    got = got.collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(plain_ids(t))
    for i, texts in want.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        ids = texts[0]
        assert all(r["doc_tokens"] == len(ids) for r in got if r["doc_id"] == i)
        assert sum(n for _, n, _ in mine) == len(ids) * len(texts)
        covered = np.zeros(len(ids), int)
        for start, n, crc in mine:
            covered[start:start + n] += 1
            assert crc == zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())
        assert (covered == len(texts)).all()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts))
        total = sum(n for _, n in parts)
        assert total == size or total & (total - 1) == 0
    assert bin_slack.pack(docs.limit(0), PATH).count() == 0
