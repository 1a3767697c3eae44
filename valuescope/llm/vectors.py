"""Near-duplicate vectors by product quantisation.

Vectors are compared only under equal labels (and equal length); vectors that
are null, zero, or hold null or non-finite components, and rows without label or
id, link with nothing.

1. Equal vectors of a label form a class; one representative goes on.
2. Coarse centroids and residual sub-space codebooks are fitted on a bounded
   sample (SAMPLE classes with the smallest hash of their vector). Every row is put
   in the inverted list of its nearest centroid, with its residual codes.
3. Sufficient probes: a vector within distance r of x can lie in the list of
   centroid c only if x is within r of the plane between c and x's own centroid.
   So x visits just the lists with (d(x,c)^2 - d(x,c0)^2) / (2 |c - c0|) <= r.
4. In a list, table lookups give the distance of a visitor to each coded member;
   with the member's coding error e, members farther than r + e cannot match.
   What is left is compared by the exact cosine in double precision.
Both bounds are exact, so no pair is missed (recall 1). Lists of more than BLOCK
members are compared block by block. A block gives link counts and a spanning
forest, never its pairs; components are found on the forest edges.

A row is a vector of its own, also where its id repeats: classes have numbers of their own, so different
vectors of one id have their own links and may lie in different components, and equal or near vectors of
one id link like any others. An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuescope.llm.common import components, saved

LEAST, SAMPLE, BLOCK = 0.98, 8000, 256
PARTS, CODES, STEPS = 8, 16, 12


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2.0 * x @ c.T).argmin(1)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


class Quantiser:
    """Coarse centroids and residual codebooks of one vector length."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = kmeans(x, min(lists, len(x)), 1)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cols = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [kmeans(rest[:, c], min(CODES, len(x)), 2 + k) for k, c in enumerate(self.cols)]

    def probes(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each row, and a mask of the lists that it has to visit (its home too)."""
        c = self.coarse
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * x @ c.T
        home = d.argmin(1)
        gap = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * c @ c.T, 0.0))[home]
        return home, (d - d.min(1, keepdims=True)) <= 2.0 * r * gap + 1e-6

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and the distance between each row and what its codes stand for."""
        rest = x - self.coarse[home]
        got = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cols, self.books, strict=True)], 1)
        back = np.concatenate([b[got[:, k]] for k, b in enumerate(self.books)], 1)
        return got, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distance of every row of x to every coded member of list ``home``, by table lookup."""
        rest = x - self.coarse[home]
        out = np.zeros((len(x), len(codes)))
        for k, (c, b) in enumerate(zip(self.cols, self.books, strict=True)):
            look = ((rest[:, c][:, None, :] - b[None]) ** 2).sum(2)
            out += look[:, codes[:, k]]
        return np.sqrt(out)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) edges that connect what the pairs connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
    return [(x, r) for x in up if (r := root(x)) != x]


def unit(values: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(values, np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    n = np.sqrt(((x / scale) ** 2).sum(1, keepdims=True)) * scale
    return x, x / n


def near_vectors(emb: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row."""
    r = float(np.sqrt(2.0 - 2.0 * least)) + 1e-6
    src = emb.select(emb[id_col].cast("long").alias("vec_id"), emb[vec_col].cast("array<double>").alias("e"), emb[label_col].alias("label"))
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("e", good), F.lit(False))
             & F.coalesce(F.exists("e", lambda v: v != 0), F.lit(False)))
    src = saved(src.withColumn("e", F.when(sound, F.transform("e", lambda v: v + 0.0))))
    classes = src.where("e is not null").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = saved(saved(classes).withColumn("cls", F.monotonically_increasing_id()))  # written, so the number of a class stays
    total = classes.count()
    lists = max(8, min(SAMPLE // 20, int(total**0.5)))
    sample = classes.orderBy(F.xxhash64("e"), "rep").limit(SAMPLE).select("e").collect()
    by: dict[int, list] = {}
    for row in sample:
        by.setdefault(len(row["e"]), []).append(row["e"])
    models = {n: Quantiser(unit(v)[1], lists) for n, v in by.items()}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list that a class visits; member: it lives there."""
        for b in batches:
            cls, e, size, n = (b.column(k) for k in range(4))
            vals, rows = e.to_pylist(), {}
            for k, m in enumerate(n.to_pylist()):
                rows.setdefault(m, []).append(k)
            for dim, at in rows.items():
                if dim in models:
                    home, mask = models[dim].probes(unit([vals[k] for k in at])[1], r)
                    i, c = np.nonzero(mask)
                    member = home[i] == c
                else:
                    i, c, member = np.arange(len(at)), np.full(len(at), -1), np.ones(len(at), bool)
                take = pa.array(np.array(at)[i])
                yield pa.RecordBatch.from_arrays([cls.take(take), e.take(take), size.take(take), n.take(take), b.column(4).take(take),
                                                  pa.array(c, pa.int32()), pa.array(member)],
                                                 names=["cls", "e", "size", "dim", "class_label", "list", "member"])

    label_type = dict(classes.dtypes)["label"]
    cells = classes.select("cls", "e", "size", F.size("e").alias("dim"), F.col("label").alias("class_label")).mapInArrow(
        index, f"cls long, e array<double>, size long, dim int, class_label {label_type}, list int, member boolean")
    cells = saved(cells)
    key = ["class_label", "dim", "list"]
    counts = cells.groupBy(*key).agg(F.ceil(F.count_if("member") / BLOCK).cast("int").alias("nb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"))
    cells = cells.join(counts.where("nb > 0"), key)
    member = cells.where("member").select(*key, "cls", "e", "size", F.lit(True).alias("member"), F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int").alias("b"),
                                          F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("v"))
    visitor = cells.select(*key, "cls", "e", "size", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"),
                           F.pmod(F.xxhash64("cls"), F.col("nv")).cast("int").alias("v"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        mine = g[g.member]
        them = g[~g.member]
        empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        if not len(mine) or not len(them):
            return empty
        y, uy = unit(list(mine.e))
        x, ux = unit(list(them.e))
        dim, at = int(g.dim.iloc[0]), int(g.list.iloc[0])
        if dim in models:
            q = models[dim]
            codes, err = q.codes(uy, np.full(len(uy), at))
            i, j = np.nonzero(q.distances(ux, at, codes) <= r + err[None] + 1e-6)
        else:
            i, j = (k.ravel() for k in np.indices((len(x), len(y))))
        a, b = them.cls.to_numpy(), mine.cls.to_numpy()
        other = a[i] != b[j]
        i, j = i[other], j[other]
        dot = np.einsum("ij,ij->i", x[i], y[j])
        hit = dot / (np.sqrt(np.einsum("ij,ij->i", x, x))[i] * np.sqrt(np.einsum("ij,ij->i", y, y))[j]) >= least
        i, j = i[hit], j[hit]
        if not len(i):
            return empty
        links = np.bincount(i, weights=mine["size"].to_numpy()[j], minlength=len(a)).astype(np.int64)
        edges = forest(a[i], b[j])
        return pd.concat([pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": 0}),
                          pd.DataFrame({"a": a[links > 0], "b": a[links > 0], "links": links[links > 0]})]).astype(np.int64)

    found = saved(member.unionByName(visitor).groupBy(*key, "b", "v").applyInPandas(compare, "a long, b long, links long"))
    near = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    info = classes.join(near, "cls", "left").join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least_id = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    info = info.join(least_id, "root").select("label", "e", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = src.join(info, ["label", "e"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
