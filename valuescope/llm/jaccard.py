"""N-gram Jaccard join by a size-aware heavy-light scheme.

A text's set holds hashes of its distinct five-word shingles (the whole sequence
where it has fewer words). Texts with equal sets form a class; classes, not
texts, are joined. Two sets link when their Jaccard similarity is at least LEAST.

1. Size decides the side. Small sets (at most the boundary) are light: all
   their shingles are posted, and every PAIR-size subset of the rare end of the
   shared ones becomes a signature. Large sets are heavy: the inverted lists of
   the rare end of their shared shingles are scanned (sets beyond FULL post their
   smallest hashes only, a quarter of the set and a tenth more). Sets up to 4/3 of the boundary take
   part on both sides, so a pair always meets on one. The boundary is the one
   with the least estimated cost over the measured sizes.
2. Shingles that only one class posts are of no use; a class with too few shared
   shingles for any link leaves (exact bounds, see ``needed``).
3. Each signature has a pivot, its member with the commonest shingles: the likeliest
   original of a group of near copies. A class first meets one pivot of its
   signatures; verified links give components, and signatures inside one component
   are closed. So a group of copies that link to their original costs its size.
4. The members of the open signatures of a pivot form one group: any two classes
   that share an open signature are in one. Groups are dealt in blocks, bounded by
   rows and bytes, and each pair of blocks is a task's work: pairs of different
   components pass an exact bound on bit sketches (see ``sketch``), what is left is
   verified on the whole sets, and links unite components inside the task. A set is
   moved once a pair of blocks, never once a pair of classes; pairs are never rows.
5. Every link is verified on the whole sets.

Shingles are compared by 64-bit hashes and classes by 64-bit set digests.
Null and empty texts have an empty set and link with nothing. Rows without id
get their size, no component, and link with nothing. Repeated rows give equal
rows. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuescope.llm.bpe import mix
from valuescope.llm.common import components, row_key, saved

WORDS, PAIR = 5, 2
#: Sets up to this size (and their partners, up to 4/3 of it) post all their shingles, larger ones a part.
FULL = 512
#: Estimates for the cost of a boundary: share of classes that survive, mean length of a scanned list.
SURVIVE, LIST = 0.15, 3.0
BOUNDARIES = (8, 12, 16, 24, 32, 48, 64, 96)
#: A block of a group: classes, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: 64-bit words of a set's bit sketch.
SKETCH = [f"w{k}" for k in range(8)]
CACHE = 200_000


def overlap(n: int) -> int:
    """Least number of shingles of a set of size n that any partner shares: ceil(3 n / 4)."""
    return -(-3 * n // 4)


def spare(n: int) -> int:
    return max(1, min(overlap(n), n // 10))


def posted(n: int, boundary: int) -> int:
    """How many of its smallest hashes a set posts. The first ``spare`` shared hashes of a pair are always among them."""
    return n if 3 * n <= 4 * max(boundary, FULL) else n - overlap(n) + spare(n)


def needed(n: int, boundary: int, light: bool) -> int:
    """Least number of posted shingles that a set has in common with any partner on this side."""
    return overlap(n) if light or n <= FULL else spare(overlap(n))


def best_boundary(sizes: list[tuple[int, int]]) -> int:
    """The boundary with the least estimated cost: postings, subsets of light sets, scanned lists of heavy ones."""

    def cost(x: int) -> float:
        total = 0.0
        for n, k in sizes:
            total += k * posted(n, x)
            if 3 * n <= 4 * x:
                total += k * SURVIVE * math.comb(max(0, n - overlap(n)) + PAIR, PAIR)
            if n > x:
                total += k * SURVIVE * LIST * (posted(n, x) - needed(n, x, False) + 1)
        return total

    return min(BOUNDARIES, key=lambda x: (cost(x), x))


def odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of an odd number and of its inverse, modulo 2^64."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        steps = np.full(n, x, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


#: A random 64-bit number of each byte, and which bytes are white space.
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: An odd multiplier for each place of a shingle.
PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
#: Texts are hashed in runs of about this many characters.
RUN = 1 << 18


def word_hashes(raw: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word. ``raw`` begins and ends with white space. A word's hash is a polynomial in its
    letters' numbers, taken from running sums over all bytes, and mixed with its length."""
    blank = BLANK[raw]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = LETTER[raw]
    sums *= power[:len(raw)]
    np.cumsum(sums, out=sums)
    return first, mix((sums[end - 1] - sums[first - 1]) * inverse[first] ^ (end - first).astype(np.uint64))


def shingle_sets(texts: list[str | None], power: np.ndarray | None = None, inverse: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    low = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(low) + b"\n", np.uint8)
    if power is None or len(power) < len(raw):
        power, inverse = odd_powers(len(raw))
    first, h = word_hashes(raw, power, inverse)
    bounds = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in low)]) + 1)
    whole = len(h) - WORDS + 1
    grams = mix(sum((h[j:whole + j] * PLACE[j] for j in range(1, WORDS)), h[:whole] * PLACE[0])) if whole > 0 else h[:0]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo:hi - WORDS + 1]))
        elif hi > lo:
            out.append(mix(np.sum(h[lo:hi] * PLACE[:hi - lo], keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def in_runs(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of consecutive texts of a batch."""
    power, inverse = odd_powers(RUN + (RUN >> 1))
    at = 0
    while at < len(column):
        texts, size = [], 0
        while at + len(texts) < len(column) and size < RUN:
            t = column[at + len(texts)].as_py()
            texts.append(t)
            size += len(t or "")
        yield at, shingle_sets(texts, power, inverse)
        at += len(texts)


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def sizes_of(src: DataFrame) -> DataFrame:
    """doc_id, n, sid (digest of the set; null where it is empty), and key where ``src`` has it."""
    more = src.columns[2:]

    def run(batches):
        for b in batches:
            for lo, sets in in_runs(b.column(1)):
                s = b.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([len(x) for x in sets], pa.int64()),
                                                  pa.array([digest(x) if len(x) else None for x in sets], pa.int64()), *s.columns[2:]],
                                                 names=["doc_id", "n", "sid", *more])

    return src.mapInArrow(run, "doc_id long, n long, sid long" + "".join(f", {c} long" for c in more))


def postings_of(src: DataFrame, boundary: int) -> DataFrame:
    """token, sid: what each class posts; repeated sets of a task post once."""

    def run(batches):
        done = set()
        for b in batches:
            for _, sets in in_runs(b.column(1)):
                token, sid = [], []
                for x in sets:
                    if len(x) < 3 or (d := digest(x)) in done:  # smaller sets link with equal sets only
                        continue
                    if len(done) > CACHE:
                        done.clear()
                    done.add(d)
                    x = x[:posted(len(x), boundary)]
                    token.append(signed(x))
                    sid.append(np.full(len(x), d))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token), pa.int64()), pa.array(np.concatenate(sid), pa.int64())],
                                                     names=["token", "sid"])

    return src.where("doc_id is not null").mapInArrow(run, "token long, sid long")


def signatures_of(shared: DataFrame, boundary: int) -> DataFrame:
    """sig, sid, n, hub of the classes that keep enough shared shingles; ``shared`` has sid, n, parts (df, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).value_lengths().to_numpy()
            df, token = (c.to_numpy() for c in b.column(2).flatten().flatten())
            order = np.lexsort((token, df, np.repeat(np.arange(len(size)), size)))  # of each class the rarest first
            df, token = np.log(df[order]), token[order].view(np.uint64)
            ends = np.cumsum(size)
            sigs, sids, ns, hubs = [], [], [], []
            for sid, n, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True):
                t, got = token[lo:hi], []
                if n > boundary and len(t) >= (c := needed(n, boundary, False)):
                    got.append(mix(t[:len(t) - c + 1] ^ np.uint64(1)))
                if 3 * n <= 4 * boundary and len(t) >= (c := needed(n, boundary, True)):
                    low = np.sort(t[:len(t) - c + PAIR])
                    i, j = np.triu_indices(len(low), 1)
                    got.append(mix(mix(low[i] ^ np.uint64(2)) ^ low[j]))
                for g in got:
                    sigs.append(signed(g))
                    sids.append(np.full(len(g), sid))
                    ns.append(np.full(len(g), n))
                    hubs.append(np.full(len(g), df[lo:hi].sum() / posted(n, boundary)))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (sigs, sids, ns, hubs)], names=["sig", "sid", "n", "hub"])

    return shared.mapInArrow(run, "sig long, sid long, n long, hub double")


def sketch(x: np.ndarray) -> np.ndarray:
    """512 bits, one set for the first nine bits of each hash, as eight 64-bit words.

    Every bit in which two sketches differ stands for at least one hash that only one of the sets
    has, and similar sets differ in at most a seventh of the sum of their sizes.
    """
    bits = np.zeros(64 * len(SKETCH), np.uint8)
    bits[x >> np.uint64(55)] = 1
    return np.packbits(bits).view(np.int64)


def sets_of(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, n, toks (sorted hashes, 8 bytes each) and sketch words of the wanted (doc_id, sid)."""

    def run(batches):
        for b in batches:
            for lo, sets in in_runs(b.column(0)):
                sid, n, toks, words = [], [], [], []
                for x, want in zip(sets, b.column(1).slice(lo, len(sets)).to_pylist(), strict=True):
                    if len(x) and digest(x) == want:
                        sid.append(want)
                        n.append(len(x))
                        toks.append(x.tobytes())
                        words.append(sketch(x))
                if sid:
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(toks, pa.binary()),
                                                      *map(pa.array, np.array(words).T)], names=["sid", "n", "toks", *SKETCH])

    schema = "sid long, n long, toks binary, " + ", ".join(f"{w} long" for w in SKETCH)
    return src.join(wanted, "doc_id").select("text", "sid").mapInArrow(run, schema)


def similar(m: np.ndarray, k: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least 0.75."""
    at = np.searchsorted(m, k)
    both = int((m[np.minimum(at, len(m) - 1)] == k).sum())
    return 100 * both >= 75 * (len(m) + len(k) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only the sets of the pairs are moved."""

    def run(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets = sets.select("sid", "toks").join(ends, "sid", "left_semi")
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fits(a: str, b: str):
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid; key of the text if ``keyed``) of every row, and (sid, root): classes that link directly or through others."""
    src = _texts(docs, id_col, text_col)
    sizes = saved(sizes_of(src.withColumn("key", row_key(src, "text")) if keyed else src))
    top = max(BOUNDARIES) * 4 // 3
    hist = sizes.where("n > 2").groupBy(F.least("n", F.lit(top + 1)).alias("n")).agg(F.count("*").alias("k")).collect()
    boundary = best_boundary([(r["n"], r["k"]) for r in hist])
    classes = saved(sizes.where("sid is not null and doc_id is not null").groupBy("sid", "n").agg(F.min("doc_id").alias("doc_id")))

    p = postings_of(src, boundary).selectExpr(
        "token", "sid", "min(sid) over (partition by token) as lo", "max(sid) over (partition by token) as hi",
        "count(1) over (partition by token) as df")
    p = p.where("lo <> hi").groupBy("sid").agg(F.collect_set(F.struct("df", "token")).alias("parts"))
    shared = p.join(classes.select("sid", "n"), "sid").select("sid", "n", "parts")
    sig = saved(signatures_of(shared, boundary))
    sig = saved(open_of(sig.withColumn("root", F.col("sid"))))
    sets = saved(sets_of(src, classes.select("doc_id", "sid").join(sig.select("sid").distinct(), "sid", "left_semi")))

    hub = F.struct(-F.col("hub"), "sid")
    pivots = saved(sig.groupBy("sig").agg(F.min_by(F.struct(F.col("sid").alias("p"), F.col("n").alias("m"), F.col("hub").alias("h")), hub).alias("c")).select("sig", "c.*"))
    met = sig.join(pivots, "sig").where("sid <> p").where(fits("n", "m")).groupBy("sid").agg(F.min_by("p", F.struct(-F.col("h"), "p")).alias("p"))
    links = saved(verified(met.select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct(), sets))
    comp = components(links)
    rooted = sig.drop("root").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    members = open_of(rooted).join(pivots.select("sig", "p"), "sig").select("p", "sid", "root").distinct()
    more = saved(block_links(saved(members), sets))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return sizes, comp.select(F.col("node").alias("sid"), "root")


def united(g: pa.Table) -> list[tuple[int, int]]:
    """Links between the two blocks of one group (or inside its only block) that unite components."""
    g = g.sort_by("sid")  # the same links however the rows come in
    sid, n, root, own = (g[c].to_numpy() for c in ("sid", "n", "root", "own"))
    words = np.stack([g[w].to_numpy() for w in SKETCH], 1).view(np.uint64)
    sets = [np.frombuffer(t, np.uint64) for t in g["toks"].to_pylist()]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    i, j = g["i"][0].as_py(), g["j"][0].as_py()
    mine = np.arange(len(g)) if i == j else np.flatnonzero(own == i)
    them = mine if i == j else np.flatnonzero(own == j)
    found = []
    for k in mine.tolist():
        may = them[(root[them] != root[k]) & (100 * np.minimum(n[them], n[k]) >= 75 * np.maximum(n[them], n[k]))]
        may = may[may > k] if i == j else may
        apart = np.bitwise_count(words[may] ^ words[k]).sum(1)
        for x in may[7 * apart <= n[may] + n[k]].tolist():
            a, b = top(root[k]), top(root[x])
            if a != b and similar(sets[k], sets[x]):
                up[max(a, b)] = min(a, b)
                found.append((int(sid[k]), int(sid[x])))
    return found


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that unite the components of each group p; ``members`` has p, sid, root."""
    size = sets.select("sid", F.length("toks").alias("bytes"))
    room = members.join(size, "sid").groupBy("p").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    nb = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    room = saved(room.where("lo <> hi").select("p", nb.alias("nb"), "c", "bytes"))
    total = room.agg(F.sum(F.col("c") * F.col("nb")).alias("rows"), F.sum(F.col("bytes") * F.col("nb")).alias("bytes")).first()
    tasks = max(1, math.ceil((total["rows"] or 0) / (4 * BLOCK)), math.ceil((total["bytes"] or 0) / (4 * BLOCK_BYTES)))
    m = members.join(room.select("p", "nb"), "p").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    m = m.withColumn("task", F.pmod(F.xxhash64("p", "i", "j"), F.lit(tasks))).drop("nb", "other").join(sets, "sid")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("p", "ascending"), ("i", "ascending"), ("j", "ascending")])
        keys = np.stack([t[c].to_numpy() for c in ("p", "i", "j")])
        ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(t)]
        found = [x for lo, hi in zip(ends, ends[1:]) if hi - lo > 1 for x in united(t.slice(lo, hi - lo))]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return m.groupBy("task").applyInArrow(run, "a long, b long")


def open_of(sig: DataFrame) -> DataFrame:
    """Rows (sig, sid, n, hub, root) of the signatures whose members lie in more than one component."""
    live = sig.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    return sig.join(live, "sig")


def named(sizes: DataFrame, comp: DataFrame) -> DataFrame:
    """``sizes`` with component_id, the least id of the component, and first, the class that has it (of several, the least sid)."""
    least = sizes.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low")).join(comp, "sid", "left")
    least = least.withColumn("root", F.coalesce("root", "sid"))
    low = least.groupBy("root").agg(F.min("low").alias("component_id"), F.min_by("sid", F.struct("low", "sid")).alias("first"))
    return sizes.join(least.join(low, "root").select("sid", "component_id", "first"), "sid", "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row."""
    return named(*join_classes(docs, id_col, text_col)).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key of the text) of the rows that stay: per component the class with the least id, and there the rows with that id.

    Rows that link with nothing stay: those without words and those without id.
    """
    out = named(*join_classes(docs, id_col, text_col, keyed=True))
    return out.where("doc_id is null or sid is null or (doc_id = component_id and sid = first)").select("doc_id", "key")
