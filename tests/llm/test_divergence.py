"""Source divergence against plain Python with whole numbers, and the SQL twins of this subpackage against Spark."""

import re
from collections import Counter, defaultdict

import pytest

from tests.conftest import SMALL
from valuescope.llm import divergence, queries
from valuescope.parity import compare

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    texts, groups = defaultdict(list), set()
    for text, lang, source in rows:
        groups.add((lang or "", source or ""))
        texts[lang or ""].append((source or "", TERM.findall((text or "").translate(LOWER))))
    out = []
    for lang, some in texts.items():
        df = Counter(t for _, words in some for t in set(words))
        kept = sorted(t for t, k in df.items() if k >= least)
        n = defaultdict(Counter)
        for source, words in some:
            for t in words:
                if df[t] >= least:
                    n[source][t] += 1
                    n[None][t] += 1
        total = {s: sum(c.values()) for s, c in n.items()}
        p = lambda s, t: 1 + 10**9 * (n[s][t] + 1) // (total.get(s, 0) + len(kept))  # noqa: E731, B023
        own = sorted(s for g, s in groups if g == lang)
        for a in own:
            pairs = [(sum((p(a, t) - p(b, t)) ** 2 // p(b, t) for t in kept), b) for b in own if b != a]
            terms = [((p(a, t) - p(None, t)) ** 2 // p(None, t), t) for t in kept if n[a][t] and p(a, t) > p(None, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, a, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


ROWS = [("The the CAT éa", "en", "a"), ("the cat", "en", "a"), ("the dog éa", "en", "b"), ("the dog éa", "en", "b"), ("the dog éa", "en", "c"),
        ("cat-cat 1cat2", "en", "c"), (None, "en", "d"), ("", None, None), ("lone words", None, "x"), ("Éa éa ÉA éa", "en", "a"),
        ("the " * 50 + "cat", "en", "b"), ("x", "de", "one"), ("x", "de", "one"), ("x X x", "de", "one"), ("日本 日本", "en", "a"),
        ("日本 dog", "en", "b"), ("日本", "en", "a"), ("the cat", "en", None)]


@pytest.mark.parametrize("least,top", [(3, 200), (1, 2), (2, 1)])
def test_divergence_against_plain_python(spark, monkeypatch, least, top):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    docs = spark.createDataFrame([(i % 5 or None, *r, "z", 1) for i, r in enumerate(ROWS)],
                                 "doc_id long, text string, lang string, source string, term string, rank int").repartition(4)
    assert rows_of(divergence.divergence(docs, least, top)) == plain(ROWS, least, top)


def test_terms_of_long_texts_are_cut_at_their_ends(spark):
    text = "ab é" * 2_000_000 + " end"
    rows = [(text, "en", "a"), ("ab", "en", "b"), ("ab end", "en", "b"), ("ab end é", "en", "b")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert rows_of(divergence.divergence(docs, 1, 9)) == plain(rows, 1, 9)


def test_divergence_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rows_of(divergence.divergence(docs)) == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, duck_small, name):
    got = compare(spark, duck_small, name, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert got["status"] == "match", got
