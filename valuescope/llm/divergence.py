"""Source divergence audit: how far the words of a source lie from those of others, in whole numbers.

1. Identical texts of a language are one row with the number of rows that each
   source has of it (a text goes by its SHA-256; it is moved once, after a
   map-side collapse, so a text that fills a third of all rows is a few rows).
2. Each distinct text is cut into terms once; its counts and document
   frequencies are weighted by those numbers and summed per task before they
   are shuffled.
3. A language keeps the terms that stand in at least LEAST of its rows. With V
   kept terms and N occurrences of them, a group that has ``count`` of a term
   gives it p = 1 + floor(SCALE (count + 1) / (N + V)).
4. Part ``pair``: for each ordered pair of sources of a language the sum over all
   V terms of f(p, q) = floor((p - q)^2 / q). It is evaluated sparsely: terms that
   neither source has come as one product, terms that one has from a histogram
   of its counts, and only terms that both have are looked at one by one. The
   sources of a term are a short list; pairs are summed in the task, never
   emitted per term.
5. Part ``term``: the TOP terms of a group that it has more of than its language
   (p > q, q the language's p) by f.

Null text, lang and source count as ''. Repeated rows and null ids count as rows;
ids and other columns are not looked at. A group without terms has its pairs and
no terms; a language without kept terms has pairs of value 0; a language with
one source has no pairs. Ties rank by the item's bytes. An empty table gives an
empty result. Sums stay within 64 bits while V is below 10^9.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuescope.llm.common import saved

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Runs of bytes of ASCII letters and of characters beyond ASCII: the terms of a UTF-8 text.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A long text is read in slices of this many bytes, each carried on to the end of its term.
SLICE = re.compile(rb"(?s).{1,4194304}[^\x00-\x40\x5B-\x60\x7B-\x7F]*")
SLICE_BYTES = 1 << 22
#: Entries that a task holds, and pairs that it evaluates at once.
HELD, BLOCK = 400_000, 1 << 20


def collapsed(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, by (source and number of rows), text: one row per distinct text of a language."""
    blank = lambda c, k: F.coalesce(docs[c].cast("string"), F.lit("")).alias(k)
    d = docs.select(blank(lang_col, "lang"), blank(source_col, "source"), blank(text_col, "text"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = d.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    by = rows.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("by"))
    texts = d.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(by, ["lang", "digest"]).select("lang", "by", F.col("text").cast("binary").alias("text"))


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (rows), to be summed: each text is cut into terms once."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            some = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays(
                [*some, pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([df[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        for b in batches:
            for lang, by, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                low = text.as_py().lower()  # bytes: A-Z only
                once = by[0]["n"] == 1 and len(by) == 1
                if once and len(low) < SLICE_BYTES:
                    n, df = held[lang, by[0]["source"]]
                    words = TERM.findall(low)
                    n.update(words)
                    df.update(set(words))
                else:
                    own: Counter = Counter()
                    for part in SLICE.finditer(low):
                        own.update(TERM.findall(part[0]))
                    for s in by:
                        n, df = held[lang, s["source"]]
                        for term, k in own.items():
                            n[term] += k * s["n"]
                            df[term] += s["n"]
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from flush(held)
        yield from flush(held)

    return texts.mapInArrow(run, "lang string, source string, term string, n long, df long")


def kept_terms(part: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n of the kept terms. One shuffle: sums by source and by language share the deal by term."""
    n = part.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    n = n.withColumns({"lang_n": F.sum("n").over(term), "df": F.sum("df").over(term)})
    return n.where(F.col("df") >= least).drop("df")


def weight(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kinds)), exact: 38 digits hold the product."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", top, F.greatest(total + kinds, F.lit(1)).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shared_sums(kept: DataFrame) -> DataFrame:
    """lang, source, item, value: what terms that both sources have add to the sums over single sources."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}  # the number of a lang and source
        sums: dict[int, int] = defaultdict(int)

        def add(size: np.ndarray, own: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
            first, size = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)  # of each row: where its term begins, its sources
            ends = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1  # rows in runs of about BLOCK pairs
            for rows in np.split(np.arange(len(own)), ends):
                a = np.repeat(rows, size[rows])
                b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
                a, b = a[a != b], b[a != b]
                v = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                pair, at = np.unique(own[a] << 32 | own[b], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, v)
                for k, x in zip(pair.tolist(), total.tolist(), strict=True):
                    sums[k] += x

        def flush() -> pa.RecordBatch:
            back = list(names)
            keys = list(sums)
            out = pa.RecordBatch.from_arrays(
                [pa.array([back[k >> 32][0] for k in keys], pa.string()), pa.array([back[k >> 32][1] for k in keys], pa.string()),
                 pa.array([back[k & 0xFFFFFFFF][1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())],
                names=["lang", "source", "item", "value"])
            sums.clear()
            return out

        for b in batches:
            some = b.column(1)
            rows, size = some.flatten(), pc.list_value_length(some).to_numpy().astype(np.int64)
            lang, source = b.column(0).dictionary_encode(), rows.field("source").dictionary_encode()
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            codes, at = np.unique(np.repeat(lang.indices.to_numpy().astype(np.int64), size) << 32 | source.indices.to_numpy(), return_inverse=True)
            number = [names.setdefault((langs[c >> 32], sources[c & 0xFFFFFFFF]), len(names)) for c in codes.tolist()]
            add(size, np.array(number, np.int64)[at], rows.field("p").to_numpy(), rows.field("p0").to_numpy())
            if len(sums) > HELD:
                yield flush()
        if sums:
            yield flush()

    lists = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("some")).where(F.size("some") > 1)
    return lists.select("lang", "some").mapInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    kept = saved(kept_terms(term_counts(collapsed(docs, text_col, lang_col, source_col)), least))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    vocabulary = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    of_lang = vocabulary.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kinds"))
    groups = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))))
    groups = groups.distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = saved(groups.withColumn("p0", weight(F.lit(0).cast("long"), F.col("total"), F.col("kinds"))))

    kept = kept.join(groups, ["lang", "source"]).withColumns({
        "p": weight(F.col("n"), F.col("total"), F.col("kinds")), "q": weight(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))})
    by_value = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value())).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    both = groups.select("lang", "source", "p0", "terms", "kinds").join(other, "lang").where("source <> item")
    neither = both.select("lang", "source", "item", ((F.col("kinds") - F.col("terms") - F.col("item_terms")) * apart(F.col("p0"), F.col("q0"))).alias("value"))
    hist = saved(kept.groupBy("lang", "source", "p").agg(F.count("*").alias("k")))
    mine = hist.join(other.select("lang", "item", "q0"), "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("k") * apart(F.col("p"), F.col("q0"))).alias("value"))
    theirs = hist.withColumnRenamed("source", "item").join(groups.select("lang", "source", "p0"), "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("k") * apart(F.col("p0"), F.col("p"))).alias("value"))
    pairs = neither.unionByName(mine).unionByName(theirs).unionByName(shared_sums(kept.select("lang", "source", "term", "p", "p0")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value()))
    cols = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return cols(pairs, "pair").unionByName(cols(terms, "term"))


SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, unnest(words) AS term FROM d),
u AS (SELECT lang, unnest(list_distinct(words)) AS term FROM d),
kept AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY o.lang, o.source, o.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
dense AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) AS HUGEINT) AS p
    FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang
    LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
lq AS (SELECT lt.lang, lt.term, CAST(1 + (1000000000::HUGEINT * (lt.n + 1)) // (ln.total + v.v) AS HUGEINT) AS q
    FROM lt JOIN ln USING (lang) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(pv.value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
terms AS (SELECT a.lang, a.source, a.term AS item, ((a.p - lq.q) * (a.p - lq.q)) // lq.q AS value
    FROM dense a JOIN lq ON lq.lang = a.lang AND lq.term = a.term WHERE a.n > 0 AND a.p > lq.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
                   FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
