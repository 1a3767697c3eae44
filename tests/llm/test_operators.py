"""The text-preparation operators against brute force on small fixtures with nulls, empty texts, ties and repeats."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from valuescope.llm import bpe, exact, html_text, jaccard, licenses, mixing, packing, pieces, token_counts, toxicity, vectors

PATH = public_tokenizers.path("piece_bpe_32k.model")
LONG = "the quick brown fox jumps over the lazy dog " * 400
TEXTS = ["", None, "a", "  two   words\n", "The GNU General Public License, all rights reserved; CC BY 4.0", LONG, LONG, LONG + "end",
         "日本語 ▁ テスト🙂  x", "\t\r\n", "Licensed under the Apache License, Version 2.0.", "a a a a a a a a", "<s> </s> <unk> <0x0A>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", 1, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "  two   words\n", None, None, None, None), (None, "no id here", "de", "src1", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (licenses.scan(none), mixing.mix(none), pieces.encode(none, PATH), token_counts.count_tokens(none, PATH), packing.pack(none, PATH),
               jaccard.near_groups(none), toxicity.toxicity(none, labels), exact.exact_groups(none),
               html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
               vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert df.count() == 0


def test_license_scan(docs):
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    for r in got:
        if r["doc_id"] is None:
            continue
        w = words.findall((TEXTS[r["doc_id"]] or "").translate(lower))
        at = [(k, lab) for p, lab in licenses.BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert r["first_word"] == min((k for k, _ in at), default=None) and r["last_word"] == max((k for k, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert by_id(licenses.scan(docs))[10]["labels"] == "apache"
    assert len(licenses.rules()) > 200


def test_mixing(docs):
    got = mixing.mix(docs)
    assert got.count() == docs.count()
    assert all(0 <= r["probability"] <= 1 for r in got.collect())
    cells = {("a", "x"): 60.0, ("a", "y"): 20.0, ("b", "x"): 10.0, ("b", "y"): 30.0}
    fit = mixing.rake(cells, {"s": {"a": 0.5, "b": 0.5}, "t": {"x": 0.6, "y": 0.4}}, budget=0.3)
    assert abs(fit["a", "x"] + fit["a", "y"] - 0.5) < 1e-6 and abs(fit["a", "x"] + fit["b", "x"] - 0.6) < 1e-6


def test_license_short_notices(spark):
    want = {"Released under the GPL v3": "gpl", "Licensed under the GPL v2.": "gpl", "LGPL-2.1+": "lgpl", "this is GPLv3 code": "gpl", "CC0": "cc0",
            "dual MIT/Apache-2.0": "apache,mit", "Apache-2.0 OR MIT": "apache,mit", "GPL 2.0 or later": "gpl", "AGPLv3": "agpl", "available under the MIT": "mit",
            "licensed under MPL 2.0": "mpl", "distributed under the GNU GPL": "gpl", "CC0 1.0 Universal": "cc0",
            "MIT Licensed": "mit", "BSD-3-Clause": "bsd-3-clause", "BSD 2 clause licence": "bsd-2-clause", "distributed under the BSD license": "bsd", "BSD licensed": "bsd",
            "summit licensed guides, a clause of the bsd port": "", "we limit the apache helicopters available under the table": "", "commit to apache": "", "gpl": ""}
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")))
    assert {t: got[i]["labels"] for i, t in enumerate(want)} == want


@pytest.mark.parametrize("named", [2000, 3])
def test_mixing_meets_the_margins_of_every_source(spark, monkeypatch, named):
    monkeypatch.setattr(mixing, "NAMED", named)
    n = {"a": 350, "hot": 1200, "b": 420, "c": 500, "d": 330, None: 350}
    rows = [(k, "lorem ipsum " * (60 + k % 3), ["en", "en", "en", "de", "fr", "es", "xx"][k % 7], s) for s, m in n.items() for k in range(m)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(None, None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    total = sum(r["n_tokens"] for r in got)
    cells, goal = {}, {}
    for r in got:
        if r["n_tokens"]:
            goal[r["source"]] = goal.get(r["source"], 0) + r["n_tokens"] / total
    goal = {s: v**mixing.TEMPER for s, v in goal.items()}
    goals = [goal, dict(mixing.LANGS), dict(mixing.TOPICS)]
    where = lambda r: (r["source"], r["lang"] if r["lang"] in mixing.LANGS else "*", r["topic"])
    for r in got:
        if r["n_tokens"]:
            cells[where(r)] = cells.get(where(r), 0) + r["n_tokens"]
    goals[1]["*"] = sum(v for c, v in cells.items() if c[1] == "*") / total
    fit = {c: v / total for c, v in cells.items()}
    for k, g in enumerate(goals):
        seen = {c[k] for c in cells}
        every = sum(v for x, v in g.items() if x in seen)
        goals[k] = {x: v / every for x, v in g.items() if x in seen}
    for _ in range(500):  # brute force
        for k, g in enumerate(goals):
            now = {x: sum(v for c, v in fit.items() if c[k] == x) for x in g}
            fit = {c: min(cells[c] / total / mixing.BUDGET, v * g[c[k]] / now[c[k]]) for c, v in fit.items()}
    for r in got:
        want = fit[where(r)] * mixing.BUDGET * total / cells[where(r)] if r["n_tokens"] else 1
        assert abs(r["probability"] - want) < 1e-6
    for x, v in goals[0].items():
        have = sum(r["probability"] * r["n_tokens"] for r in got if r["n_tokens"] and r["source"] == x) / mixing.BUDGET / total
        assert abs(have - v) < 1e-3
    assert goals[0]["hot"] < 0.8 * 1200 / 3150


def test_mixing_of_more_sources_than_the_driver_takes(spark, monkeypatch):
    """2,001 small sources and a hot one: the frame gives what the driver's fit gives, and rows as they are."""
    rows = [(k, "lorem ipsum " * (9 if k // 2001 == 1 else 65 + k % 5), ["en", "de", "fr", "es", "xx"][k % 5], f"s{k % 2001}") for k in range(3 * 2001)]
    rows += [(9000 + k, "dolor sit " * (70 if k % 3 else 9), ["en", "de", "fr", "es"][k % 4], "hot") for k in range(3000)]
    rows += [(1, "", "en", "s1"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    key = lambda r: tuple("" if x is None else str(x) for x in r[:5])
    far = sorted(mixing.mix(docs, budget=0.1).collect(), key=key)
    monkeypatch.setattr(mixing, "NAMED", 10_000)
    near = sorted(mixing.mix(docs, budget=0.1).collect(), key=key)
    assert len(far) == len(near) == len(rows)
    for a, b in zip(far, near, strict=True):
        assert a[:5] == b[:5] and abs(a["probability"] - b["probability"]) < 1e-6 and abs(a["weight"] - b["weight"]) < 1e-6


def test_mixing_counts_and_topics_of_odd_texts(spark):
    """All kinds of space, marks and letters by plain rules."""
    parts = ["a", "Zz9", "é", "日本", "🙂", "\u00a0", "\u0085", "\u200b", "\x00", "\x1c", "\x7f", " ", "  ", "\t", "\n", "\x0b", "\f", "\r", *map(chr, range(0x21, 0x30)), *map(chr, range(0x3A, 0x41)),
             "[", "`", "{", "~", " | ", "%&", "$#*", "x"]
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\r\n\t\x0b\f ", "x", "x ", " x", "!", " ! ", "x!x", "xx xx", "".join(parts)]
    texts += ["".join(rng.choice(parts, size=rng.integers(1, 40))) for _ in range(400)]
    texts += [y + " word" * 130 for x in mixing.LICENSED for y in (x, x.upper(), x.title(), x.replace(" ", "  "), x[:-1], x.replace("i", "\u0130"), x.replace("s", "\u017f"))]
    texts += ["a | b " * 70, "a | | b " * 70, "one two % " * 70, "w " * 119, "w " * 120]

    def topic(t, n):
        if re.search("licensed under|rights reserved|public license|the mit license", t, re.I | re.A):
            return "licensed"
        if t.count(" | ") * 8 > n:
            return "tabular"
        return "noisy" if sum(map(t.count, "%&$#*")) * 8 > n else "brief" if n < 120 else "prose"

    got = by_id(mixing.mix(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")))
    for i, t in enumerate(texts):
        n = len(re.findall(r"[^ \t\n\x0B\f\r\x21-\x2F\x3A-\x40]+|[\x21-\x2F\x3A-\x40]+", t or ""))
        assert (got[i]["n_tokens"], got[i]["topic"]) == (n, topic(t or "", n)), repr(t)
    assert {r["topic"] for r in got.values()} == set(mixing.TOPICS)


def test_mixing_reads_texts_without_lists_of_matches_or_ranges(docs, monkeypatch):
    """The pass over the texts makes no list of all tokens, looks no letter up in a map, and its classes have no ranges (Java tries these one by one)."""
    seen, keep = [], mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    assert mixing.mix(docs).count() == docs.count()
    assert "regexp_replace(" in seen[0]
    for dear in ("regexp_extract_all(", "translate(", "RLIKE", r"\s", r"\x21-"):
        assert dear not in seen[0]


def test_pieces_decode_losslessly_and_vary(docs):
    got = pieces.encode(docs, PATH).collect()
    assert len(got) == docs.count() and all(r["lossless"] for r in got)
    m = bpe.model(PATH)
    for r in got:
        if r["doc_id"] is not None:
            assert pieces.decode(m, r["ids"]) == (TEXTS[r["doc_id"]] or "")
    plain = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, PATH, rate=0.0).collect()}
    assert plain[5] == m.sp.encode(LONG) and plain[5] != by_id(pieces.encode(docs, PATH))[5]["ids"]


def test_pieces_draw_skips_for_each_occurrence(spark):
    m, n, long = bpe.model(PATH), 400, "xyz" * bpe.LONG
    text = "the river " * n + long + " ünïcode ▁ \U0001f642 " + long
    rows = [(1, text), (2, text), (None, text)]
    got = by_id(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH))
    for i, _ in rows:  # brute force: each occurrence by the heap agenda with its own key
        us = pieces.cut(text)
        own = [pieces.spelled(m, bpe.merge_one(m, m.symbols(u), k, pieces.SEED, pieces.RATE)) for u, k in zip(us, pieces.keys_of(i, len(us), pieces.SEED), strict=True)]
        assert np.frombuffer(b"".join(own), np.int32).tolist() == got[i]["ids"] and got[i]["lossless"]
        word = bpe.units("a river")[1]
        plain = np.array(bpe.merge_one(m, m.symbols(word)), np.int32).tobytes()
        forms = [x for u, x in zip(us, own, strict=True) if u == word]
        merges = len(word) - len(plain) // 4
        assert len(set(forms)) > 4 and 0.8 * 0.9**merges < forms.count(plain) / n < 1  # other merges may lead to the plain form, too
    assert got[1]["ids"] != got[2]["ids"]


def test_token_counts(docs):
    sp = bpe.model(PATH).sp
    for r in token_counts.count_tokens(docs, PATH).collect():
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(sp.encode(t)))
            assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_long_unit_agenda_equals_library():
    m = bpe.model(PATH)
    for t in ("abcab" * 60, "x" * 500, "ththe" * 90):
        assert len(bpe.merge_rows(m, [m.symbols(u) for u in bpe.units(t)])[0]) == len(m.sp.encode(t))


def test_packing_is_lossless(docs):
    rows = packing.pack(docs, PATH, size=64).collect()
    sp, back = bpe.model(PATH).sp, {}
    for r in rows:
        ids, pos = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        for k, (d, off) in enumerate(zip(r["doc_ids"], r["offsets"], strict=True)):
            a, b = r["cu_seqlens"][k], r["cu_seqlens"][k + 1]
            assert pos[a:b].tolist() == list(range(b - a))
            back.setdefault((d, off), ids[a:b].tolist())
    for i, t in enumerate(TEXTS):
        parts = [back[k] for k in sorted(k for k in back if k[0] == i and k[0] is not None)]
        assert sum(parts, []) == sp.encode(t or "")


def test_best_fit_takes_the_fullest_row():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]


def test_html_text(spark):
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>First   para with\n several words here.<p>Second "
            "paragraph, also long enough.</p><div class=\"ad\">Buy now and save.</div><p>Third one ends.</p></article>"
            "<section id=comments><p>Nice article, I liked it.</p></section><footer>&copy; us</footer><script>var x='</p>';</script></body></html>")
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (None, "w", "<p>" * 3000 + "deep text stays"), (5, "z", "<div <p> &am")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    one = [r for r in got if r["page_id"] == 1]
    want = "A & B\nFirst para with several words here.\nSecond paragraph, also long enough.\nThird one ends."
    assert [r["text"] for r in one] == [want, want] and one[0]["n_chars"] == len(want)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]


def test_html_text_names_do_not_decide_alone():
    long = " ".join(f"Word{k}" for k in range(29)) + " end."
    para = f"<p>{long}</p>"
    for page in (f"<div class='content has-sidebar'>{para}{para}</div>", f"<div class=no-sidebar>{para}</div>", f"<div id=page-with-header>{para}</div>",
                 f"<article class='post comment-open'>{para}</article>", f"<div class=widget><article>{para}{para}</article></div>",
                 f"<div class=widget><main>{para}</main></div>", f"<div class='modal'><p>{long * 6}</p></div>",
                 f"<html><head><title>t</title><meta charset=utf-8><body>{para}", f"<head><title>t</title>{para}", f"<head><link href=x> {long}"):
        assert long in html_text.main_text(page)[0], page
    for page in (f"<div class=sidebar>{para}</div>", f"<section id=comments>{para}</section>", f"<div class='has-footer comments'>{para}</div>",
                 f"<nav><article>{para}</article></nav>", "<head><title>no text</title><style>p</style></head>", f"<div hidden><main>{para}</main></div>"):
        assert html_text.main_text(page)[0] == "", page


def test_min_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 6
        src, snk = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return (sum(snk[k] if side[k] else src[k] for k in range(n)) + sum(c for a, b, c in edges if side[a] != side[b]))

        best = min(cost([(m >> k) & 1 for k in range(n)]) for m in range(2**n))
        assert math.isclose(cost(html_text.min_cut(src, snk, edges)), best, abs_tol=1e-6)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    vecs = [(i, (base[i % 6] + rng.normal(size=16) * 0.08).tolist(), i % 2) for i in range(400)]
    vecs += [(1000 + k, vecs[0][1], 0) for k in range(5)]
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 1), (2004, vecs[0][1], None),
           (2005, [1.0, 2.0], 0), (2006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    x = np.array([np.array(v[1], np.float32).astype(float) for v in vecs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([v[2] for v in vecs])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    assert link.sum() > 1000
    assert [got[v[0]]["n_links"] for v in vecs] == link.sum(1).tolist()
    comp = np.array([v[0] for v in vecs])
    while not (comp == (new := np.minimum(comp, np.where(link, comp[None], 10**9).min(1)))).all():
        comp = new
    assert [got[v[0]]["component_id"] for v in vecs] == comp.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(2000, 2005))
    assert (got[2006]["n_links"], got[2006]["component_id"], got[2006]["kept"]) == (1, 2005, False)


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size in (1, 3, 6, 8, 12, 30, 120, 700):
        for g in range(3):
            words = [f"w{g}{k}" for k in rng.integers(0, 10**6, size)]
            for _ in range(8):
                w = list(words)
                for k in rng.integers(0, size, rng.integers(0, 1 + size // 20 + (size < 30))):
                    w[k] = f"z{rng.integers(0, 10**6)}"
                texts.append(" ".join(w))
    texts += ["", None, " \t", texts[40].upper()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if comp[i] != comp[j] and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    got = jaccard.near_groups(df).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {
        i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = [f"word{k}" for k in "abcdefghijklmnop"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 30))
        bad = i % 4 == 0
        if bad:
            w[5:5] = ["idiot", "scum", "m0ron" if i % 8 else "moron"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(9000, "you are an 1d1ot and sсum"), (9001, ""), (9002, None), (None, "idiot scum moron")]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["predicted"] == y for i, _, y in labels)
    assert by[9000]["predicted"] == 1 and by[9001]["predicted"] == by[9002]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))


@pytest.mark.parametrize("toxic", [3, 6, 10])
def test_toxicity_with_few_toxic_rows(spark, toxic):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:toxic + 60]
    labels = spark.createDataFrame([(i, 1, int(k < toxic)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    plain = {i: f"quiet word{i} river" for i in ids}
    marked = {i: f"quiet word{i} {'idiot' if k < toxic else 'river'}" for k, i in enumerate(ids)}
    for texts, bad in ((plain, 0), (marked, toxic)):  # nothing to learn: every row is clean
        docs = spark.createDataFrame([*texts.items(), (900, None), (901, "")], "doc_id long, text string")
        model = toxicity.learn(docs, labels)
        assert bool(model["lexicon"]) == bool(bad) and model["curve"][0] < 0
        assert {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()} == set(ids[:bad])
        assert toxicity.clean(docs, model).count() == len(ids) + 2 - bad


def test_exact_groups(docs):
    got = exact.exact_groups(docs).collect()
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in TEXTS]
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            same = [i for i, n in enumerate(norm) if n == norm[r["doc_id"]]]
            assert r["keep_id"] == min(same) and r["kept"] == (r["doc_id"] == min(same))
            assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
            assert r["group_size"] == len(same) + (3 in same)


@pytest.mark.parametrize("block", [1024, 7])
def test_block_links_unite_what_similar_pairs_unite(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(3, 400)), dtype=np.int64).view(np.uint64) * np.uint64(2)
        near = base[: max(3, int(len(base) * rng.uniform(0.5, 1)))]
        rows += [(2 * k, np.unique(base)), (2 * k + 1, np.unique(near))]
    words = [[int(w) for w in jaccard.sketch(x)] for _, x in rows]
    sets = spark.createDataFrame([(i, len(x), bytearray(x.tobytes()), *w) for (i, x), w in zip(rows, words, strict=True)],
                                 "sid long, n long, toks binary, " + ", ".join(f"{w} long" for w in jaccard.SKETCH))
    members = spark.createDataFrame([(k % 2 * 5, i, i - i % 2 if i > 100 else i) for k in range(2) for i in range(len(rows))], "p long, sid long, root long")
    got = {(r["a"], r["b"]) for r in jaccard.block_links(members.distinct(), sets).collect()}
    similar = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard.similar(rows[i][1], rows[j][1])}
    plain = {(i, j) for i, j in similar if 100 * (both := len(np.intersect1d(rows[i][1], rows[j][1]))) >= 75 * (len(rows[i][1]) + len(rows[j][1]) - both)}
    assert similar == plain and similar
    assert {tuple(sorted(x)) for x in got} == {x for x in similar if x[1] <= 100 or x[0] % 2 or x[1] != x[0] + 1}


def test_shingles_of_runs_are_those_of_each_text():
    texts = ["a b c d e f", "A b  c\nd e f g", "x", "", None, "x ", "\t", "one two\x0bthree four five", "ab c", "a bc", "É é " * 9, LONG]
    got = jaccard.shingle_sets(texts)
    alone = [jaccard.shingle_sets([t])[0] for t in texts]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, alone, strict=True))
    for t, x in zip(texts, got, strict=True):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert len(x) == (len({tuple(w[k:k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w))
    assert np.isin(got[0], got[1]).all() and got[2] == got[5] and got[8] != got[9]


def test_vectors_of_a_repeated_id_stand_alone(spark):
    rows = [(1, [1.0, 0.0, 0.0], 7), (1, [0.0, 1.0, 0.0], 7), (2, [1.0, 0.01, 0.0], 7), (3, [0.01, 1.0, 0.0], 7), (4, [0.0, 0.0, 1.0], 7), (4, [0.0, 0.01, 1.0], 7)]
    got = sorted(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


WORDS_30 = " ".join(f"word{k}" for k in range(30)) + "."


@pytest.mark.parametrize("page,want", [
    (f'<article><p class="a"">{WORDS_30}</p></article>', WORDS_30),
    (f"<article><p>{WORDS_30}<img src=x alt=Bob's></p><p>{WORDS_30}</p></article>", f"{WORDS_30}\n{WORDS_30}"),
    (f"<article><p>if x<y and then {WORDS_30}</p></article>", f"if x<y and then {WORDS_30}"),
    (f'<article><p>{WORDS_30}</p><p>{WORDS_30} <a href="foo>in</a> it</p></article>', f"{WORDS_30}\n{WORDS_30} in it"),
    (f'<article><p title="a > b">{WORDS_30}</p></article>', WORDS_30),
    (f"<div class=search-results><p>{WORDS_30}</p><p>{WORDS_30}</p></div>", f"{WORDS_30}\n{WORDS_30}"),
    (f"<div class=legal><p>{WORDS_30}</p></div>", WORDS_30), ("Hello there", "Hello there"), ('<div class="menu">a b</div>', ""),
])
def test_html_text_of_odd_markup(page, want):
    assert html_text.main_text(page)[0] == want


def test_many_stray_closing_tags_are_linear():
    import time
    t = time.time()
    html_text.main_text("<div>" * 20000 + "</p>" * 20000 + "x")
    assert time.time() - t < 2


def test_toxicity_sample_has_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "same words"), *[(2, f"text {k}") for k in range(50)], (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 0), (3, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample_of(docs, labels).collect()
    import zlib
    kept = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert len(rows) == len(kept)
