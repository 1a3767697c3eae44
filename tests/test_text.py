"""TF-IDF retrieval against a brute-force cosine on the same tokens (sf0.001)."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from valuescope.operators import text as T

from .conftest import MEDIUM, SMALL


def test_tfidf_topk_matches_brute_force(spark):
    ch, idf, wd = T.tfidf_index(spark, SMALL)
    wq = T.query_vectors(spark, SMALL, idf)
    docs = defaultdict(dict)
    for r in wd.collect():
        docs[r["cid"]][r["term"]] = r["wd"]
    queries = defaultdict(dict)
    for r in wq.collect():
        queries[r["item_id"]][r["term"]] = r["wq"]
    # vectors are unit length
    for v in list(docs.values())[:20]:
        assert abs(math.sqrt(sum(x * x for x in v.values())) - 1.0) < 1e-9
    expect = {}
    for q, qv in queries.items():
        sc = []
        for c, dv in docs.items():
            s = sum(w * dv.get(t, 0.0) for t, w in qv.items())
            if s > T.MIN_SCORE:
                sc.append((-round(s, T.DECIMALS), c))
        expect[q] = [c for _, c in sorted(sc)[:T.TOP_K]]
    got = defaultdict(list)
    for r in T.tfidf_topk(spark, SMALL).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append(f'{r["doc_id"]}:{r["chunk_no"]}')
    assert {q: v for q, v in expect.items() if v} == dict(got)


@pytest.mark.parametrize("k,low", [(3, 0.05), (1, 0.0), (50, 0.2)])
def test_pruned_retrieval_equals_the_full_product(spark, k, low):
    """Made vectors with ties, repeats and a term that every chunk has."""
    rng = random.Random(7)
    rows = []
    for c in range(300):
        words = {f"t{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(12)} | {"all"}
        ws = {t: rng.choice([1.0, 1.0, 2.0, 5.0]) * (0.2 if t == "all" else 1.0) for t in words}
        norm = math.sqrt(sum(w * w for w in ws.values()))
        rows += [(f"{c // 2 if c % 7 == 0 else c}:{c}", t, w / norm) for t, w in ws.items()]
    wd = spark.createDataFrame(rows, "cid string, term string, wd double")
    lists = T.lists_of(wd)
    wq = wd.where("cast(split(cid, ':')[1] as int) % 10 = 0").select(F.col("cid").alias("item_id"), "term", F.col("wd").alias("wq"))
    got = T.retrieval(lists, wq, k, low)
    full = T.product(wq, lists)
    want = {(r["item_id"], r["rank"]): (r["cid"], round(r["score"], 6)) for r in T.best(full.where(F.col("score") > low), k).collect()}
    mine = {(r["item_id"], r["rank"]): (r["cid"], round(r["score"], 6)) for r in T.best(got["scored"].where(F.col("score") > low), k).collect()}
    assert mine == want
    assert T.best(full, 2).count() == 2 * wq.select("item_id").distinct().count()


def test_pruning_reads_a_part_of_the_lists(spark):
    ch, idf, _ = T.tfidf_index(spark, MEDIUM)
    lists, wq = T.inverted_lists(spark, MEDIUM), T.query_vectors(spark, MEDIUM, idf)
    got = T.retrieval(lists, wq, T.TOP_K, T.MIN_SCORE, T._saver(spark))
    every = wq.join(lists, "term").count()
    read, pairs = T.reads(got["terms"], lists).count(), got["candidates"].count()
    assert 5 * read < 2 * every and 6 * pairs < every, (read, pairs, every)


def test_both_ways_give_the_same_rows(spark):
    one, two = (sorted(map(tuple, T.tfidf_topk(spark, SMALL, full_rows=n).collect())) for n in (0, 10**9))
    assert one == two and one


def test_stop_words_are_those_of_the_library(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert {w for w in StopWordsRemover.loadDefaultStopWords("english") if re.fullmatch(r"\w\w+", w)} == set(T.STOP_WORDS)


def test_chunks_keep_whole_text(spark):
    ch = T.chunks(spark, SMALL)
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = d.agg(F.sum(F.length("text"))).first()[0]
    assert ch.agg(F.sum(F.length("text"))).first()[0] == total


def _documents(spark, rows):
    import tempfile
    folder = tempfile.mkdtemp(prefix="vs-docs-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_counts_and_ranks_of_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one id are one vector; the ways that score rows where they are read, all lists and pruned lists agree."""
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(20).collect()]
    ids = [None if i % 13 == 0 else i // 2 if i % 5 == 0 else 1000 + i for i in range(len(texts))]
    folder = _documents(spark, [(i, t, "en", "s", None) for i, t in zip(ids, texts)] + [(5000, None, "en", "s", None), (5001, "", "en", "s", None)])
    ct = T.chunk_terms(spark, folder)
    want = {r["term"]: r["df"] for r in ct.groupBy("term").agg(F.count("*").alias("df")).collect()}
    got = {r["term"]: r["df"] for r in T.document_counts(spark, folder).collect()}
    assert got.pop(None) == T.chunk_table(spark, folder).count() and got == want
    rows, full, pruned = (sorted(map(str, T.tfidf_topk(spark, folder, full_rows=n).collect())) for n in (None, 10**9, 0))
    assert rows == full == pruned and len(rows) > 20
    for most in (0, 200):  # few terms are held: the lengths come from entries that are shuffled
        monkeypatch.setattr(T, "HELD_TERMS", most)
        assert sorted(map(str, T.tfidf_topk(spark, folder).collect())) == full


def test_vocabulary_shuffles_no_pairs_of_chunk_and_term(spark, monkeypatch):
    def fails(*_):
        raise AssertionError("the pairs of chunk and term are written")
    monkeypatch.setattr(T, "chunk_terms", fails)
    assert T.tfidf_vocabulary(spark, SMALL).count() > 100
    assert T.tfidf_topk(spark, SMALL).count() > 0


def test_copies_are_ranked_by_id_in_small_batches(spark, monkeypatch):
    rows = [("a", ["x", "y"]), ("c", ["x"]), ("b", ["x"]), ("e", ["z", "x"]), ("d", ["x"]), ("f", []), ("g", ["other"]), ("h", None)]
    batch = T.pa.RecordBatch.from_arrays([T.pa.array([c for c, _ in rows]), T.pa.array([w for _, w in rows], T.pa.list_(T.pa.string())),
                                          T.pa.array([1.0 if c == "g" else 0.0 for c, _ in rows])], names=["cid", "words", "rest"])
    q = T.pa.table({"item_id": [1, 2, 2], "term": ["x", "y", "z"], "wq": [1.0, 0.6, 0.8]})
    v = T.pa.table({"term": ["x", "y", "z"], "idf": [1.0, 1.0, 1.0]})
    for cells in (1, 4, 1000):
        monkeypatch.setattr(T, "CELLS", cells)
        got = [r for out in T.best_in_batches(q, v, 2, 0.1)(iter([batch])) for r in out.to_pylist()]
        best = {i: sorted((-round(r["score"], 9), r["cid"]) for r in got if r["item_id"] == i)[:2] for i in (1, 2)}
        assert best[1] == [(-1.0, "b"), (-1.0, "c")] and [c for _, c in best[2]] == ["e", "a"]
    assert len(got) == 4
