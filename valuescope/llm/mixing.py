"""Mixing sources to target weights by raking (DataFrame functions).

1. Every row gets its token weight (words and marks of the whole text), and its
   language and topic as categories: those that a target names, "*" for all
   others (nulls too). Topics come from ordered rules on the whole text.
   Every source is a category of its own, null too; its target is its share of
   tokens to the power TEMPER, rescaled.
2. Token weights are summed per cell, in a frame. Up to NAMED sources, proven by
   a count, its cells are fitted on the driver (bounded by NAMED and the target
   lists). Beyond that they stay in the frame, a row per source with its cells
   by language and topic; the same steps run in its tasks and only the sums of
   these few columns come to the driver (``rake_frame``). No source is pooled.
3. Iterative proportional fitting scales the cells to each margin in turn, until
   a round moves less than TOL of the tokens; it warns where ROUNDS do not do.
   Each fitted cell is bounded by the tokens it has within the budget, so that no
   document is needed twice; margins are met as far as these bounds allow.
4. A cell's sampling probability is its fitted share of the budget over its
   tokens; a keyed hash of the id decides for each row.

Targets of categories without tokens are left out and the rest rescaled. Rows
without tokens have weight 0 and stay. Repeated rows share one decision; a null
id is hashed as 0 with the length of its text. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuescope.llm.common import row_key, saved

REST = "*"
#: A source's target is its share to this power; up to so many sources are fitted on the driver, with equal results.
TEMPER, NAMED = 0.5, 2000
#: Rounds of fitting at most, the share of tokens that a last round may still move, and the rounds between two written states.
ROUNDS, TOL, WRITTEN = 500, 1e-9, 25
#: Shares of tokens wanted; "*" pools every category that is not named.
LANGS = {"en": 0.52, "de": 0.18, "fr": 0.18, "es": 0.12}
TOPICS = {"licensed": 0.03, "tabular": 0.07, "noisy": 0.05, "brief": 0.10, "prose": 0.75}
#: Share of all tokens that the sample should hold.
BUDGET = 0.7
#: Space and marks, as members of a class one by one: Java finds these in a table, and tries ranges and \s one after another.
SPACES = r"\x20\t\n\x0B\f\r"
MARKS = "".join(rf"\x{k:02X}" for k in (*range(0x21, 0x30), *range(0x3A, 0x41)))
#: In lower case; a text with one of these is licensed.
LICENSED = ("licensed under", "rights reserved", "public license", "the mit license")
#: What decides about a row besides its id.
KEY = ("text", "source", "lang")


@dataclass
class Targets:
    source: dict | None = None  # None: tempered shares of the table's sources
    lang: dict = field(default_factory=lambda: dict(LANGS))
    topic: dict = field(default_factory=lambda: dict(TOPICS))

    def dims(self) -> dict[str, dict | None]:
        return {"source": self.source, "lang": self.lang, "topic": self.topic}


def token_count(text: Column) -> Column:
    """Runs of words and of marks: each becomes one letter, with the space after it, and the letters are counted."""
    return F.length(F.ltrim(F.regexp_replace(text, rf"(?:[^{SPACES}{MARKS}]++|[{MARKS}]++)[{SPACES}]*+", "x"), F.lit(" \t\n\x0b\f\r"))).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The first rule that holds names the topic."""
    bars = F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("  ")))
    noise = F.length(text) - F.length(F.regexp_replace(text, "[%&$#*]+", ""))
    lower = F.lower(text)
    return (F.when(functools.reduce(Column.__or__, [F.contains(lower, F.lit(x)) for x in LICENSED]), "licensed")
            .when(bars * 8 > tokens, "tabular").when(noise * 8 > tokens, "noisy")
            .when(tokens < 120, "brief").otherwise("prose"))


def category(col: Column, wanted: dict) -> Column:
    return F.when(col.isin([k for k in wanted if k != REST]), col).otherwise(F.lit(REST))


def aims(have: dict[str, float], wanted: dict[str, float]) -> dict[str, float]:
    """Targets of the categories that have tokens, adding up to 1; where "*" has none, its share (of 1) stays."""
    goal = {x: wanted.get(x, v if x == REST else 0.0) for x, v in have.items()}
    every = sum(goal.values())
    return {x: v / every if every else 1 / len(goal) for x, v in goal.items()}


def ratio(goal: np.ndarray, now: np.ndarray) -> np.ndarray:
    return np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)


def stopped(rounds: int, moved: float) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds; the last one still moved {moved:.2g} of the tokens", stacklevel=3)


def rake(cells: dict[tuple, float], targets: dict[str, dict], budget: float = BUDGET, rounds: int = ROUNDS, tol: float = TOL) -> dict[tuple, float]:
    """Fitted share of each cell; starts at its share of tokens."""
    total = sum(cells.values())
    keys = sorted(c for c, v in cells.items() if v > 0)
    if not keys:
        return {}
    w = np.array([cells[c] / total for c in keys])
    most, sides = w / budget, []
    for k, wanted in enumerate(targets.values()):
        place = {x: j for j, x in enumerate(sorted({c[k] for c in keys}))}
        at = np.array([place[c[k]] for c in keys])
        goal = aims(dict(zip(place, np.bincount(at, w).tolist(), strict=True)), wanted)
        sides.append((at, np.array([goal[x] for x in place])))
    for _ in range(rounds):
        before = w
        for at, goal in sides:
            w = np.minimum(most, w * ratio(goal, np.bincount(at, w, len(goal)))[at])
        moved = float(np.abs(w - before).sum())
        if moved < tol:
            break
    else:
        stopped(rounds, moved)
    return dict(zip(keys, w.tolist(), strict=True))


def own_source() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(REST))


def source_goals(table: DataFrame) -> DataFrame:
    """(cell_source, goal): tempered shares of the sources that have tokens, adding up to 1."""
    sums = saved(table.groupBy("cell_source").agg(F.sum("t").cast("double").alias("t")).where("t > 0"))
    total = sums.agg(F.sum("t")).first()[0] or 1.0
    g = F.pow(F.col("t") / total, F.lit(TEMPER))
    every = sums.agg(F.sum(g)).first()[0] or 1.0
    return sums.select("cell_source", (g / every).alias("goal"))


LINE = "cell_source string, goal double, most array<double>, w array<double>"


class Line:
    """Fitting steps on a row per source: cells are the columns, ``at`` says which language and topic each has."""

    def __init__(self, langs: list[str], topics: list[str]):
        self.cells = [(x, y) for x in langs for y in topics]
        self.at = np.array([langs.index(x) for x, _ in self.cells]), np.array([topics.index(y) for _, y in self.cells])

    def sources(self, pdf: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        return np.minimum(np.stack(pdf["most"]), w * ratio(pdf["goal"].to_numpy(), w.sum(1))[:, None])

    def after(self, pdf: pd.DataFrame, w: np.ndarray, steps: list) -> np.ndarray:
        """``w`` after whole rounds with these (language, topic) factors."""
        most = np.stack(pdf["most"])
        for step in steps:
            w = self.sources(pdf, w)
            for at, factor in zip(self.at, step, strict=True):
                w = np.minimum(most, w * factor[at])
        return w


def rake_frame(table: DataFrame, goals: DataFrame, langs: dict, topics: dict, budget: float = BUDGET,
               rounds: int = ROUNDS, tol: float = TOL, written: int = WRITTEN) -> DataFrame:
    """``rake`` for any number of sources: (cell_source, cell_lang, cell_topic, weight, probability) of the cells with tokens.

    A source has one row with at most one number per language and topic, so its step needs no shuffle. Each step of a
    language or topic needs one sum per column from all tasks. Factors since the last written state are applied anew
    in the next job; the state is written every few rounds, so lost tasks are made again from there.
    """
    few = table.groupBy("cell_lang", "cell_topic").agg(F.sum("t").cast("double").alias("t")).where("t > 0").collect()
    total = sum(r[2] for r in few)
    if not total:
        return table.sparkSession.createDataFrame([], "cell_source string, cell_lang string, cell_topic string, weight double, probability double")
    share = [{}, {}]
    for r in few:
        for k in (0, 1):
            share[k][r[k]] = share[k].get(r[k], 0.0) + r[2] / total
    want = [aims(dict(sorted(share[0].items())), langs), aims(dict(sorted(share[1].items())), topics)]
    line = Line(list(want[0]), list(want[1]))
    aim = [np.array(list(x.values())) for x in want]
    held = table.groupBy("cell_source").agg(*[F.sum(F.when((F.col("cell_lang") == x) & (F.col("cell_topic") == y), F.col("t")).otherwise(0)).cast("double").alias(f"c{k}")
                                              for k, (x, y) in enumerate(line.cells)])
    first = [F.col(f"c{k}") / total for k in range(len(line.cells))]
    state = saved(held.join(goals, "cell_source").select("cell_source", "goal", F.array(*[x / budget for x in first]).alias("most"), F.array(*first).alias("w")))

    def sums(steps: list, lang: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Sums of the columns within the next round, and how much the last round moved."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = np.zeros(len(line.cells) + 1)
            for pdf in batches:
                if len(pdf):
                    old = line.after(pdf, np.stack(pdf["w"]), steps[:-1])
                    w = line.after(pdf, old, steps[-1:])
                    got[-1] += np.abs(w - old).sum()
                    w = line.sources(pdf, w)
                    if lang is not None:
                        w = np.minimum(np.stack(pdf["most"]), w * lang[line.at[0]])
                    got[:-1] += w.sum(0)
            yield pd.DataFrame({"k": range(len(got)), "v": got})

        rows = dict(state.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
        return np.array([rows.get(k, 0.0) for k in range(len(line.cells))]), rows.get(len(line.cells), 0.0)

    def moved_on(steps: list, frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    pdf["w"] = list(line.after(pdf, np.stack(pdf["w"]), steps))
                yield pdf
        return frame.mapInPandas(run, LINE)

    steps: list = []
    for k in range(rounds + 1):
        now, moved = sums(steps)
        if k and moved < tol:
            break
        if k == rounds:
            stopped(rounds, moved)
            break
        lang = ratio(aim[0], np.bincount(line.at[0], now, len(aim[0])))
        steps.append((lang, ratio(aim[1], np.bincount(line.at[1], sums(steps, lang)[0], len(aim[1])))))
        if len(steps) > written:  # the last round stays open: the next job measures what it moved
            state, steps = saved(moved_on(steps[:-1], state)), steps[-1:]
    last = moved_on(steps, state)
    cell = F.explode(F.array(*[F.struct(F.lit(x).alias("cell_lang"), F.lit(y).alias("cell_topic"), F.get("w", k).alias("w"), F.get("most", k).alias("most"))
                               for k, (x, y) in enumerate(line.cells)])).alias("c")
    out = last.select("cell_source", cell).where("c.most > 0")
    return saved(out.select("cell_source", "c.cell_lang", "c.cell_topic", (F.col("c.w") / F.col("c.most") / budget).alias("weight"),
                            F.least(F.lit(1.0), F.col("c.w") / F.col("c.most")).alias("probability")))


def with_fit(base: DataFrame, table: DataFrame, fitted: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the fit of their cell. Sources with at least one in NAMED of the rows, of which there are at most NAMED,
    meet a broadcast; the rows of the others are shuffled, and none of these sources is large."""
    by = table.groupBy("cell_source").agg(F.sum("n").alias("n"))
    rows = table.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(by.where(F.col("n") * NAMED >= rows).select("cell_source"))
    return base.join(hot, "cell_source", "left_semi").join(F.broadcast(fitted.join(hot, "cell_source", "left_semi")), names, "left").unionByName(
        base.join(hot, "cell_source", "left_anti").join(fitted.join(hot, "cell_source", "left_anti"), names, "left"))


def mix(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, seed: int = 17, keyed: bool = False) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, weight, probability, sampled; key of KEY if ``keyed``)."""
    key = [row_key(docs, *KEY).alias("key")] if keyed else []
    dims = (targets or Targets()).dims()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
                       docs["lang"].cast("string").alias("lang"), text.alias("text"), *key)
    base = base.withColumn("n_tokens", token_count(F.col("text")))
    base = saved(base.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens",
                             F.length("text").alias("len"), *(["key"] if keyed else [])))
    cats = [category(F.col(k), v).alias(f"cell_{k}") for k, v in dims.items() if k != "source"]
    names = [f"cell_{k}" for k in dims]
    asked = dims["source"]
    base = base.select("*", (own_source() if asked is None else category(F.col("source"), asked)).alias("cell_source"), *cats)
    table = saved(base.groupBy(*names).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    goals = source_goals(table) if asked is None else None
    if goals is not None and goals.count() > NAMED:
        out = with_fit(base, table, rake_frame(table, goals, dims["lang"], dims["topic"], budget), names)
    else:
        if goals is not None:
            dims["source"] = {r["cell_source"]: r["goal"] for r in goals.collect()}
        sums = table.where("t > 0").collect()
        cells = {tuple(r[n] for n in names): float(r["t"]) for r in sums}
        share, total = rake(cells, dims, budget), sum(cells.values())
        rows = [(*c, v * total / cells[c], min(1.0, v * budget * total / cells[c])) for c, v in share.items()]
        fitted = docs.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", weight double, probability double")
        out = base.join(F.broadcast(fitted), names, "left")
    p = F.coalesce("probability", F.lit(1.0))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)), F.when(F.col("doc_id").isNull(), F.col("len"))), F.lit(1 << 53)) / float(1 << 53)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"),
                      p.alias("probability"), ((unit < p) | (F.col("n_tokens") == 0)).alias("sampled"), *(["key"] if keyed else []))
