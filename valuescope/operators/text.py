"""TF-IDF retrieval of document chunks for query texts.

Documents are split into chunks at ``## `` heading lines (whole texts, no
prefix cut), tokenised into lower-case unicode words of 2+ chars without
English stop words. Term weights follow the smooth IDF
scheme ``tf · (ln((1+n)/(1+df)) + 1)`` over all terms (or the ``vocab`` commonest), with
L2-normalised vectors, so the dot product is the cosine.

Retrieval does not score every pair that shares a term. All terms have one order,
rarest first, and every vector keeps at each of its terms the length of its tail,
the part behind it. If t is the first term that a query and a chunk share, their
score is at most the product of their weights of t and the product of both tails
behind t; and it is at most the sum of query weight times largest weight of any
chunk over the query's terms from t on.

1. Seeds: the SEEDED chunks with the most weight on a query's SEEDS rarest terms are
   scored in full; the k-th best of them is a floor under the k-th best score.
2. A query reads the inverted lists of its terms until the second bound is below
   the floor, and of a list only chunks that keep the first bound at the floor. A
   chunk outside what is read cannot be among the k best.
3. What is read gives candidates; their scores are summed over all terms, so
   scores and ranks are exact.

A search that would read few entries in all reads them all in one join: the bounds
pay where lists are long. Both ways give the same rows.

Top-k per query is two-phase (per salt bucket, then overall), so one query never
pulls all its candidates into a single task. Ranks go by the score at 9 decimals,
then the chunk id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import job
from ..functions.exprs import round_doubles
from ..functions.ranking import global_rank
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

TOP_K = 3
MIN_SCORE = 0.05
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
SALT_BUCKETS = 16
SEEDS, SEEDED = 8, 32
#: Entries of the lists up to which one plain join is cheaper than the bounds.
FULL_ROWS = 50_000_000
#: Entries of query vectors up to which every task holds them all, and how many of the commonest terms it holds (some tens of MB).
HELD_QUERIES, HELD_TERMS = 500_000, 300_000
#: Scores of chunks with queries that a task works out at a time.
CELLS = 2_000_000
#: Room for rounding where a bound meets a floor, and the decimals by which scores rank.
SLACK, DECIMALS = 1e-7, 9
# The words of 2+ letters of the English stop-word list of Spark ML.
STOP_WORDS = """
about above after again against all am an and any are as at be because been before being below between both but by can
cannot could did do does doing don down during each few for from further had has have having he her here hers herself him
himself his how if in into is it its itself just me more most my myself no nor not now of off on once only or other ought
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why will with would
you your yours yourself yourselves
""".split()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_no, heading, text): split at lines starting with '## '."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    parts = d.select("doc_id", F.posexplode(F.split("text", r"(?m)^(?=## )")).alias("chunk_no", "body"))
    first = F.regexp_extract("body", r"^## +([^\n]*)", 1)
    return parts.where(F.trim("body") != "").select(
        "doc_id", "chunk_no", F.when(first != "", F.trim(first)).otherwise(F.lit("Introduction")).alias("heading"),
        F.col("body").alias("text"))


def _terms(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids…, term, tf): lower-case unicode words of 2+ chars minus English stop words.

    Built-in expressions only, so tokenising stays in codegen."""
    tok = df.select(*id_cols, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    return tok.where(~F.col("term").isin(STOP_WORDS)).groupBy(*id_cols, "term") \
        .agg(F.count(F.lit(1)).alias("tf"))


def tokens() -> F.Column:
    """Words of ``text`` in order, stop words too."""
    return F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0)


def marked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, text, again): every chunk, and whether its document id comes more than once (null ids are one id). Chunks
    of one cid are one vector, so only those of repeated ids have to be brought together; the texts of the others stay
    where they are read."""
    from ..plans.mart import materialized
    ids = lambda: read_table(spark, sf_dir, "documents", ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    repeated = materialized(spark, "repeated_ids", sf_dir, ("documents",), ("doc_id",), lambda: ids().where("c > 1").select(F.col("doc_id").alias("_id")))
    ch = chunks(spark, sf_dir)
    return ch.join(repeated.withColumn("again", F.lit(True)), ch["doc_id"].eqNullSafe(F.col("_id")), "left").select(
        F.concat_ws(":", "doc_id", "chunk_no").alias("cid"), "text", F.coalesce("again", F.lit(False)).alias("again"))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, df): the chunks that have the term; the null term stands for all chunks. Written once per application.

    The distinct terms of a chunk are counted from its own row: a task sends a row a term, and no pair of chunk and
    term is shuffled or written but those of repeated ids."""
    from ..plans.mart import materialized

    def build() -> DataFrame:
        ch = marked_chunks(spark, sf_dir)
        words = F.array_except(tokens(), F.array(*map(F.lit, STOP_WORDS)))  # distinct ones
        once = ch.where("not again").select(F.explode(F.array_append(words, F.lit(None).cast("string"))).alias("term"))
        again = ch.where("again")
        merged = _terms(again.select("cid", "text"), ["cid"]).select("term")
        return once.unionAll(merged).unionAll(again.select(F.lit(None).cast("string").alias("term"))) \
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return materialized(spark, "tfidf_terms", sf_dir, ("documents",), (TOKEN_PATTERN, "df"), build)


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, df, idf) of all terms."""
    counts = document_counts(spark, sf_dir)
    n = (counts.where("term is null").first() or {"df": 0})["df"]
    return counts.where("term is not null").select("term", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def held_terms(idf: DataFrame, wq: DataFrame) -> DataFrame:
    """(term, idf) of the commonest terms, HELD_TERMS at most, and of all terms of queries."""
    n, least = 0, None
    for r in idf.groupBy("df").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("df")).toLocalIterator():
        n += r["c"]
        if n > HELD_TERMS:
            break
        least = r["df"]
    asked = wq.select("term").distinct().withColumn("asked", F.lit(True))
    common = F.col("df") >= F.lit(least) if least is not None else F.lit(False)
    return idf.join(asked, "term", "left").where(common | F.coalesce("asked", F.lit(False))).select("term", "idf")


def other_terms(held: pa.Array):
    """A function of Arrow batches (cid, words) of whole chunks: (cid, term, tf) of the words that are not held."""
    def run(batches):
        for b in batches:
            row, code = _coded(b)
            if not len(row):
                continue
            other = pc.is_null(pc.index_in(code.dictionary, value_set=held)).to_numpy(zero_copy_only=False)
            at = code.indices.to_numpy()
            pair, tf = np.unique((row * len(code.dictionary) + at)[other[at]], return_counts=True)
            row, at = np.divmod(pair, len(code.dictionary))
            yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(row)), code.dictionary.take(pa.array(at)), pa.array(tf)], names=["cid", "term", "tf"])
    return run


def _coded(b: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of every word of a batch, and the words."""
    words = b.column("words")
    return np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy()), words.flatten().dictionary_encode()


def best_in_batches(queries: pa.Table, vocabulary: pa.Table, k: int, min_score: float):
    """A function of Arrow batches (cid, words, rest) of whole chunks: the scores of every chunk of a batch with every query
    over all terms that they share. ``vocabulary`` has the terms of the queries; ``rest`` is the squared length of a
    chunk's vector over the words that are not in it. Of CELLS scores at a time, the k best of each query go on (more where rounding may
    order them anew)."""
    terms, idf = vocabulary["term"].combine_chunks(), vocabulary["idf"].to_numpy()
    items = queries["item_id"].combine_chunks().dictionary_encode()
    term = pc.index_in(queries["term"].combine_chunks(), value_set=terms).to_numpy()
    order = np.argsort(term, kind="stable")  # a list of queries for each term
    item, wq, many = items.indices.to_numpy()[order], queries["wq"].to_numpy()[order], np.bincount(term, minlength=len(terms))
    first, n_items = np.cumsum(many) - many, len(items.dictionary)

    def vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code = _coded(b)
        place = pc.fill_null(pc.index_in(code.dictionary, value_set=terms), -1).to_numpy()[code.indices.to_numpy()]
        pair, tf = np.unique((row * len(terms) + place)[place >= 0], return_counts=True)
        row, place = np.divmod(pair, max(len(terms), 1))
        w = tf * idf[place]
        norm = np.sqrt(np.bincount(row, w * w, b.num_rows) + b.column("rest").to_numpy())
        return row, place, w / norm[row]

    def run(batches):
        for b in batches:
            row, place, w = vectors(b)
            held = many[place] > 0
            row, place, w = row[held], place[held], w[held]
            cells = np.cumsum(np.bincount(row, many[place], b.num_rows) + n_items) // CELLS
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(cells)) + 1):
                if not len(rows) or not n_items:
                    continue
                lo, hi = np.searchsorted(row, [rows[0], rows[-1] + 1])
                n = many[place[lo:hi]]
                of = np.repeat(np.arange(lo, hi), n)  # an entry of a chunk meets the queries of its term
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[place[of]]
                s = np.bincount((row[of] - rows[0]) * n_items + item[at], w[of] * wq[at], len(rows) * n_items).reshape(len(rows), n_items)
                least = np.full(n_items, min_score)
                if len(rows) > k:
                    least = np.maximum(least, np.partition(s, len(rows) - k, axis=0)[len(rows) - k] - 2 * 10.0 ** -DECIMALS)
                r, i = np.nonzero((s >= least) & (s > min_score))
                ids = np.asarray(b.column("cid").to_pylist()[rows[0]:rows[-1] + 1], dtype=str)
                by = np.lexsort((np.argsort(np.argsort(ids))[r], s[r, i], i))  # of copies, which have one score, k by their id
                r, i = r[by], i[by]
                new = np.r_[True, (i[1:] != i[:-1]) | (s[r[1:], i[1:]] != s[r[:-1], i[:-1]])][:len(r)]
                some = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) < k
                r, i = r[some], i[some]
                yield pa.RecordBatch.from_arrays([items.dictionary.take(pa.array(i)), b.column("cid").take(pa.array(r + rows[0])), pa.array(s[r, i])],
                                                 names=["item_id", "cid", "score"])
    return run


def found_in_rows(spark: SparkSession, sf_dir: str, wq: DataFrame, idf: DataFrame, k: int, min_score: float) -> DataFrame:
    """(item_id, cid, score) with the k best chunks of every query: a chunk is scored whole, in one row. Tasks hold the
    query vectors and the commonest terms; only the entries of other terms are shuffled, for the lengths of the chunks.
    Chunks of repeated document ids are brought together by the full product."""
    ch = marked_chunks(spark, sf_dir)
    once = ch.where("not again").select("cid", F.filter(tokens(), lambda t: ~t.isin(STOP_WORDS)).alias("words"))
    held = held_terms(idf, wq).toArrow()
    score = best_in_batches(wq.select("item_id", "term", "wq").toArrow(), held, k, min_score)
    others = once.mapInArrow(other_terms(held["term"].combine_chunks()), "cid string, term string, tf long").join(idf.select("term", "idf"), "term")
    rest = others.groupBy("cid").agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("rest"))
    once = once.join(rest, "cid", "left").select("cid", "words", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    rows = once.mapInArrow(score, f"item_id {wq.schema['item_id'].dataType.simpleString()}, cid string, score double")
    merged = weighted(_terms(ch.where("again").select("cid", "text"), ["cid"]), idf)
    return rows.unionByName(product(wq, merged))


def weighted(ct: DataFrame, idf: DataFrame) -> DataFrame:
    """(cid, term, wd): unit vectors of (cid, term, tf)."""
    w = ct.join(idf.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("cid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    return w.join(norm, "cid").select("cid", "term", (F.col("w") / F.col("nrm")).alias("wd"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, doc_id, chunk_no, heading, text): the split is done once per application and written to the
    shared folder; later reads prune to the columns they need."""
    from ..plans.mart import materialized
    return materialized(spark, "chunks", sf_dir, ("documents",), ("chunks",),
                        lambda: chunks(spark, sf_dir).withColumn("cid", F.concat_ws(":", "doc_id", "chunk_no")))


def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, term, tf): tokenised once per application and written to the shared folder."""
    from ..plans.mart import materialized
    ch = chunk_table(spark, sf_dir)
    return materialized(spark, "chunk_terms", sf_dir, ("documents",), (TOKEN_PATTERN,),
                        lambda: _terms(ch.select("cid", "text"), ["cid"]))


def tfidf_index(spark: SparkSession, sf_dir: str, vocab: int | None = None):
    ct = chunk_terms(spark, sf_dir)
    idf = idf_table(spark, sf_dir)
    if vocab is not None:
        stats = ct.groupBy("term").agg(F.sum("tf").alias("cnt")).withColumn("tid", F.xxhash64("term"))
        idf = idf.join(global_rank(stats, "cnt", desc=True, tiebreak="tid").df.where(F.col("rn") <= vocab).select("term"), "term")
    return chunk_table(spark, sf_dir), idf, weighted(ct, idf)


def with_tails(vectors: DataFrame, of: str, w: str, df: DataFrame) -> DataFrame:
    """With df of the terms and ``tail``: the length of the vector behind this term, rarest terms first. A window is one vector."""
    behind = Window.partitionBy(of).orderBy(F.asc("df"), F.asc("term")).rowsBetween(1, Window.unboundedFollowing)
    return vectors.join(df, "term").withColumn("tail", F.sqrt(F.coalesce(F.sum(F.col(w) * F.col(w)).over(behind), F.lit(0.0))))


def lists_of(wd: DataFrame) -> DataFrame:
    """(term, cid, wd, df, tail) of chunk vectors (cid, term, wd)."""
    return with_tails(wd, "cid", "wd", wd.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).select("term", "cid", "wd", "df", "tail")


def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lists_of`` the index, written once per application."""
    from ..plans.mart import materialized
    return materialized(spark, "tfidf_lists", sf_dir, ("documents",), (TOKEN_PATTERN, "behind"),
                        lambda: lists_of(tfidf_index(spark, sf_dir)[2]))


def query_vectors(spark: SparkSession, sf_dir: str, idf: DataFrame) -> DataFrame:
    q = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    qt = _terms(q, ["item_id"]).join(idf.drop("df"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    qn = qt.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    return qt.join(qn, "item_id").select("item_id", "term", (F.col("w") / F.col("nrm")).alias("wq"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, cid, score) for every query–chunk pair sharing at least one term: the full product, for tests."""
    ch, idf, wd = tfidf_index(spark, sf_dir)
    wq = query_vectors(spark, sf_dir, idf)
    s = wd.join(wq, "term") \
        .groupBy("item_id", "cid").agg(F.sum(F.col("wd") * F.col("wq")).alias("score"))
    return s, ch


def bounded_terms(wq: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, term, wq, tail, place, rest): a query's terms rarest first; ``rest`` bounds what this and all commoner terms add."""
    size = lists.groupBy("term").agg(F.first("df").alias("df"), F.max("wd").alias("most"))
    t = with_tails(wq, "item_id", "wq", size)
    rare = Window.partitionBy("item_id").orderBy(F.asc("df"), F.asc("term"))  # the words of one query
    onward = rare.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return t.select("item_id", "term", "wq", "tail", F.row_number().over(rare).alias("place"),
                    F.sum(F.col("wq") * F.col("most")).over(onward).alias("rest"))


def best(s: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item by score and cid, with their rank; no item's rows are all in one task."""
    order = [F.round("score", DECIMALS).desc(), F.col("cid").asc()]
    s = s.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT_BUCKETS)))
    first = s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))) \
        .where(F.col("rank") <= k).drop("salt")


def product(terms: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, cid, score): the sum over the given terms of each item."""
    return terms.select("item_id", "term", "wq").join(lists.select("term", "cid", "wd"), "term").groupBy("item_id", "cid") \
        .agg(F.sum(F.col("wd") * F.col("wq")).alias("score"))


def scored(pairs: DataFrame, terms: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, cid, score) of the given pairs, over all terms."""
    both = pairs.join(terms.select("item_id", "term", "wq"), "item_id").join(lists.select("term", "cid", "wd"), ["term", "cid"])
    return both.groupBy("item_id", "cid").agg(F.sum(F.col("wd") * F.col("wq")).alias("score"))


def reads(terms: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, cid): the entries of the lists that are read, by ``terms`` with ``floor``."""
    least = F.col("floor") - SLACK
    q = terms.where(F.col("rest") >= least).select("item_id", "term", "wq", F.col("tail").alias("own"), "floor")
    most = F.col("wq") * F.col("wd") + F.col("own") * F.col("tail")
    return q.join(lists.select("term", "cid", "wd", "tail"), "term").where(most >= least).select("item_id", "cid")


def retrieval(lists: DataFrame, wq: DataFrame, k: int, min_score: float, save=lambda df: df) -> dict[str, DataFrame]:
    """Frames of the pruned retrieval: terms (with floor), candidates, scored."""
    terms = save(bounded_terms(wq, lists))
    seeds = best(product(terms.where(F.col("place") <= SEEDS), lists), max(k, SEEDED)).select("item_id", "cid")
    seeded = best(scored(seeds, terms, lists), k)
    floor = seeded.groupBy("item_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    floor = floor.select("item_id", F.greatest(F.lit(min_score), F.when(F.col("n") == k, F.col("low"))).alias("floor"))
    terms = save(terms.join(floor, "item_id"))  # every query term is in some chunk, so every item has seeds
    candidates = save(reads(terms, lists).distinct())
    return {"terms": terms, "candidates": candidates, "scored": scored(candidates, terms, lists)}


def _saver(spark: SparkSession):
    """Writes a frame to the shared folder and reads it back: it is read by several later steps."""
    root = ensure_checkpoint_dir(spark).rstrip("/")

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/tfidf-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return save


def _sql(tail: str) -> str:
    """DuckDB twin: the full product (every pair that shares a term), no pruning."""
    words = ", ".join(f"('{w}')" for w in STOP_WORDS)
    token = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]{2,}"
    return rf"""
WITH stop(term) AS (VALUES {words}),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)## ', '\1' || chr(1) || '## ', 'g'), chr(1)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(parts))) AS k, unnest(parts) AS body, parts[1] = '' AND len(parts) > 1 AS led FROM cut),
ch AS (SELECT doc_id, CAST(CASE WHEN led THEN k - 1 ELSE k END AS INTEGER) AS chunk_no, body,
         doc_id || ':' || CASE WHEN led THEN k - 1 ELSE k END AS cid,
         CASE WHEN regexp_extract(body, '^## +([^\n]*)', 1) <> '' THEN trim(regexp_extract(body, '^## +([^\n]*)', 1))
              ELSE 'Introduction' END AS heading
       FROM numbered WHERE NOT (led AND k = 0) AND trim(body, ' ') <> ''),
ct AS (SELECT cid, term, COUNT(*) AS tf FROM (SELECT cid, unnest(regexp_extract_all(lower(body), '{token}')) AS term FROM ch) x
       WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1, 2),
n AS (SELECT COUNT(*) AS n FROM ch),
idf AS (SELECT term, LN((1.0 + (SELECT n FROM n)) / (1.0 + COUNT(*))) + 1.0 AS idf FROM ct GROUP BY 1),
w AS (SELECT cid, ct.term, tf * idf AS w FROM ct JOIN idf ON ct.term = idf.term),
wd AS (SELECT cid, term, w / SQRT(SUM(w * w) OVER (PARTITION BY cid)) AS wd FROM w),
qt AS (SELECT item_id, term, COUNT(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{token}')) AS term FROM benchmark) x
       WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1, 2),
qw AS (SELECT item_id, qt.term, tf * idf AS w FROM qt JOIN idf ON qt.term = idf.term),
wq AS (SELECT item_id, term, w / SQRT(SUM(w * w) OVER (PARTITION BY item_id)) AS wq FROM qw),
s AS (SELECT item_id, cid, SUM(wd * wq) AS score FROM wd JOIN wq ON wd.term = wq.term GROUP BY 1, 2),
top AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ROUND(score, {DECIMALS}) DESC, cid) AS INTEGER) AS rank
        FROM s WHERE score > {MIN_SCORE})
{tail}"""


@job("tfidf_topk", sql=_sql(f"""SELECT item_id, rank, doc_id, chunk_no, heading, ROUND(score, 6) AS score
FROM top JOIN ch ON top.cid = ch.cid WHERE rank <= {TOP_K}"""))
def tfidf_topk(spark: SparkSession, sf_dir: str, k: int = TOP_K, min_score: float = MIN_SCORE, full_rows: int | None = None) -> DataFrame:
    """Top-k chunks per benchmark query by TF-IDF cosine, score above min_score (the top-k is the feature).
    Query vectors of up to HELD_QUERIES entries go to every task, and each chunk is scored in one row.
    Beyond it, or with ``full_rows``: up to as many entries (known from the terms' frequencies) all lists are read,
    and with more the pruned way is taken. All are exact."""
    idf = idf_table(spark, sf_dir)
    save = _saver(spark)
    wq = save(query_vectors(spark, sf_dir, idf))
    if full_rows is None and wq.count() <= HELD_QUERIES:
        top = best(found_in_rows(spark, sf_dir, wq, idf, k, min_score).where(F.col("score") > min_score), k)
        meta = chunks(spark, sf_dir).drop("text").withColumn("cid", F.concat_ws(":", "doc_id", "chunk_no"))
        return round_doubles(meta.join(F.broadcast(top), "cid").select("item_id", "rank", "doc_id", "chunk_no", "heading", "score"))
    ch, idf, wd = tfidf_index(spark, sf_dir)
    rows = wq.join(idf, "term").agg(F.sum("df")).first()[0] or 0
    if rows <= (full_rows if full_rows is not None else FULL_ROWS):
        found = product(wq, wd)
    else:
        found = retrieval(inverted_lists(spark, sf_dir), wq, k, min_score, save)["scored"]
    top = best(found.where(F.col("score") > min_score), k)
    meta = ch.select("cid", "doc_id", "chunk_no", "heading")
    return round_doubles(top.join(meta, "cid").select("item_id", "rank", "doc_id", "chunk_no", "heading", "score"))


@job("tfidf_vocabulary", sql=_sql("SELECT term, ROUND(idf, 6) AS idf FROM idf"))
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted vocabulary with document frequency based IDF weights."""
    return round_doubles(idf_table(spark, sf_dir).select("term", "idf"))
