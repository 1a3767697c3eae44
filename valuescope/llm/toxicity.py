"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

1. Texts are folded: lower case, look-alike letters of other scripts and digits
   and signs inside words become the letters they stand for, other characters a
   space.
2. The lexicon is learned from a bounded sample of labelled rows (per label the
   FIT rows with the smallest hash of their id; never a held-out row): words and
   word beginnings whose document frequency in toxic rows is far above that in
   clean rows. Its weights are smoothed log odds. The evidence asked for grows
   with the log of the number of terms tried, so few rows give a short lexicon
   of their clearest terms, not none.
3. Two-word phrases around a lexicon word that clean rows use and toxic rows do
   not are exceptions: they cancel the match.
4. A text's weight is normalised by its length; a logistic curve fitted on the
   same sample turns weight and density into a score.

Texts without a match, null and empty ones too, get a score below 0.5 (the curve
at weight 0). Without labels of both kinds, or where no term has the evidence,
every score is 0 and every row is clean. A null id is never held out and never in
the sample. Rows are scored one by one, so repeated rows get equal scores;
labels are joined by id with the worst label of repeated ones. Other columns
are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound: labelled rows (clean, toxic) that are fitted on.
FIT = (9000, 3000)
#: Least evidence (nats) beyond the log of the number of terms tried that a term is commoner in toxic rows.
EVIDENCE = 1.0
LEAST_DOCS, BEGINNINGS = 3, range(4, 9)
#: Curve of a model without a lexicon, and the highest intercept of any other: a text without a match is never toxic.
NO_CURVE, MOST_INTERCEPT = (-20.0, 0.0, 0.0), -0.1
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_matches long"

#: Look-alikes and the letters they stand for.
ALIKE = dict(zip("аеіоорсухѕјһԁԛԝьвкмнтαεινορτυχκμγ", "aeioopcyxsjhdqwbbkmhtaeivoptuxkuy", strict=True))
ALIKE |= {"ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "l", "ｏ": "o"} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
ALIKE_MAP = str.maketrans(ALIKE)
ALIKE_IN = re.compile("[" + "".join(ALIKE) + "]")
SIGN_IN = re.compile(r"[01345789@$!|€]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![\w])")
HIDDEN = re.compile("[­​-‏⁠﻿]")
OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """' word word ... ' with single spaces."""
    t = text.lower()
    if not t.isascii():
        if HIDDEN.search(t):
            t = HIDDEN.sub("", t)
        if ALIKE_IN.search(t):
            t = t.translate(ALIKE_MAP)
    if SIGN_IN.search(t):
        t = SIGN_IN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    return " " + OTHER.sub(" ", t).strip() + " "


def terms(folded: str) -> set[str]:
    """Whole words (' word ') and their beginnings (' wor')."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 1} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def matcher(lexicon: dict[str, float], exceptions: set[str]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for t, w in lexicon.items():
        auto.add_word(t, (len(t), w))
    for p in exceptions:
        auto.add_word(p, (len(p), None))
    if len(auto):
        auto.make_automaton()
    return auto


def matches(auto, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of each matched word, the heaviest term per word; exceptions remove what they cover."""
    if not len(auto):
        return []
    best: dict[int, float] = {}
    cover: list[tuple[int, int]] = []
    for end, (n, w) in auto.iter(folded):
        start = end - n + 1
        if w is None:
            cover.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    for a, b in cover:
        for s in [s for s in best if a <= s < b]:
            del best[s]
    return sorted(best.items())


def features(auto, text: str) -> tuple[float, float, int]:
    """(log weight, log weight per hundred words, matches)."""
    folded = fold(text)
    found = matches(auto, folded)
    weight = sum(w for _, w in found)
    return math.log1p(weight), math.log1p(100.0 * weight / max(10, folded.count(" ") - 1)), len(found)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _counts(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """Document frequencies (term, toxic, clean) of a run of texts, added up before the shuffle."""
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            df: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).slice(lo, 200).to_pylist(), b.column(1).slice(lo, 200).to_pylist(), strict=True):
                for t in each(fold(text or "")):
                    df.setdefault(t, [0, 0])[1 - y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array([v[0] for v in df.values()], pa.int64()),
                                              pa.array([v[1] for v in df.values()], pa.int64())], names=["term", "bad", "good"])


def frequencies(sample: DataFrame, each) -> DataFrame:
    return sample.select("text", "y").mapInArrow(lambda it: _counts(it, each), "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of the sampled labelled ids, one row of each (that with the least text hash); only ids, bounded by FIT, are broadcast."""
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = ids.where(~out).groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT[y]) for y in (0, 1)]
    some = pick[0].unionByName(pick[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("row")).select("row.text", "row.y")


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon, exceptions and curve. What comes to the driver is bounded by FIT: the terms with enough evidence in the texts of that many rows."""
    from valuescope.llm.common import saved

    sample = saved(sample_of(docs, labels))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"lexicon": {}, "exceptions": set(), "curve": NO_CURVE}
    if len(n) < 2:
        return model
    rate = F.log((F.col("bad") + 0.1) / (n[1] + 0.2)) - F.log((F.col("good") + 0.1) / (n[0] + 0.2))
    share, p = F.col("bad") / (F.col("bad") + F.col("good")), n[1] / (n[0] + n[1])
    nats = (F.col("bad") + F.col("good")) * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
    tried = saved(frequencies(sample, terms).where(F.col("bad") >= LEAST_DOCS))
    least = math.log(max(1, tried.count())) + EVIDENCE
    found = tried.withColumn("w", rate).where((F.col("w") > 2.0) & (nats > least))
    rows = found.orderBy("term").collect()
    lexicon = {r["term"]: float(r["w"]) for r in rows}
    if not lexicon:
        return model
    auto = matcher(lexicon, set())

    def pairs(folded: str) -> set[str]:
        got = set()
        for s, _ in matches(auto, folded):
            end = folded.index(" ", s + 1)
            after = folded.find(" ", end + 1)
            before = folded.rfind(" ", 0, s)
            if after > 0:
                got.add(folded[s:after + 1])
            if before >= 0:
                got.add(folded[before:end + 1])
        return got

    spared = frequencies(sample, pairs).where((F.col("good") >= LEAST_DOCS) & (F.col("good") * n[1] > 10 * F.col("bad") * n[0]))
    model["exceptions"] = {r["term"] for r in spared.select("term").collect()}
    model["lexicon"] = lexicon
    model["curve"] = curve(sample, lexicon, model["exceptions"])
    return model


def newton(x: np.ndarray, y: np.ndarray, side: np.ndarray, w: np.ndarray, free: list[int]) -> np.ndarray:
    """Weighted logistic fit of the coefficients ``free``; the others stay as in ``w``."""
    ridge = np.array([0.0, 0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (side * (p - y)) + ridge * w
        h = (x * (side * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.01, 0.01])
        step = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w[free] -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def curve(sample: DataFrame, lexicon: dict[str, float], exceptions: set[str]) -> tuple[float, float, float]:
    """Logistic regression (Newton steps, small ridge) of the label on the two features of the sampled rows."""

    def run(batches):
        auto = matcher(lexicon, exceptions)
        for b in batches:
            f = [features(auto, t or "")[:2] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)],
                                             names=["a", "b", "y"])

    got = sample.select("text", "y").mapInArrow(run, "a double, b double, y int").collect()
    got.sort(key=lambda r: (r["a"], r["b"], r["y"]))  # bounded by FIT; the order of the sums does not depend on the partitions
    x = np.array([(1.0, r["a"], r["b"]) for r in got])
    y = np.array([r["y"] for r in got], float)
    side = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    free = newton(x, y, side, np.zeros(3), [0, 1, 2])
    w = free if free[0] <= MOST_INTERCEPT else newton(x, y, side, np.array([MOST_INTERCEPT, 0.0, 0.0]), [1, 2])
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches: one row per row. No shuffle."""
    lexicon, exceptions, (c, a, d) = model["lexicon"], model["exceptions"], model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = matcher(lexicon, exceptions)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                f = [features(auto, t or "") for t in s.column(1).to_pylist()]
                p = [1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + d * y)))) for x, y, _ in f]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([held_out(i) for i in s.column(0).to_pylist()], pa.bool_()), pa.array(p, pa.float64()),
                     pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([k for _, _, k in f], pa.int64())],
                    names=["doc_id", "held_out", "score", "predicted", "n_matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns as they are. No shuffle."""
    lexicon, exceptions, (c, a, d) = model["lexicon"], model["exceptions"], model["curve"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = matcher(lexicon, exceptions)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                f = (features(auto, t or "") for t in s.column(at).to_pylist())
                yield s.filter(pa.array([c + a * x + d * y < 0 for x, y, _ in f], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
