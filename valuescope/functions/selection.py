"""Exact values at given ranks without a sort: two scans whatever the size.

Scan 1 asks the quantile sketch for a bracket around each rank; the sketch's rank
error is at most n / accuracy, and a bracket is wide enough for it. Scan 2 counts
the rows of each gap between brackets and each distinct value inside them, in one
grouped aggregate. Gap counts (one row a gap) say how many values lie below a
bracket, and the value at a rank is found among the bracket's distinct values,
bounded by WIDTH times n / accuracy. Should a rank fall outside its bracket the
brackets are widened and scan 2 is made again, so the result is exact whatever the
sketch answers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_ACCURACY, MOST_ACCURACY, WIDTH = 1_000, 1_000_000, 4


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def values_at(df: DataFrame, key: str, ranks: list[int], n: int, target: int) -> dict[int, float]:
    """The value at each 0-based rank of the non-null ``key`` (as double) of ``n`` rows.

    ``target`` bounds the rows that a bracket may hold by the sketch's promise.
    """
    base = df.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("v"))
    accuracy = min(MOST_ACCURACY, max(LEAST_ACCURACY, math.ceil(WIDTH * n / max(target, 1))))
    slack, found = WIDTH / 2 / accuracy, {}
    while len(found) < len(set(ranks)):
        open_ = [r for r in sorted(set(ranks)) if r not in found]
        qs = [min(max((r + 1) / n + s * slack, 0.0), 1.0) for r in open_ for s in (-1, 1)]
        edges = base.agg(F.percentile_approx("v", qs, accuracy)).first()[0]
        brackets = _merged([(edges[2 * k], edges[2 * k + 1]) for k in range(len(open_))])
        region = F.lit(2 * len(brackets))
        for k in reversed(range(len(brackets))):
            lo, hi = brackets[k]
            region = F.when(F.col("v") < lo, 2 * k).when(F.col("v") <= hi, 2 * k + 1).otherwise(region)
        counted = base.select(region.alias("region"), "v").groupBy(
            "region", F.when(F.col("region") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        totals = {r["region"]: r["c"] for r in counted.groupBy("region").agg(F.sum("c").alias("c")).collect()}  # a row a gap or bracket
        asked, below = [], 0
        for k in range(2 * len(brackets) + 1):
            asked += [(k, r, r - below) for r in open_ if below <= r < below + totals.get(k, 0) and k % 2]
            below += totals.get(k, 0)
        if asked:
            inside = counted.where(F.col("region") % 2 == 1).withColumn(  # distinct values of a bracket: bounded
                "upto", F.sum("c").over(Window.partitionBy("region").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
            want = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("long").alias("rank"), F.lit(o).cast("long").alias("o")) for k, r, o in asked]))
            hit = inside.withColumn("w", want).where("w.k = region and w.o < upto and w.o >= upto - c")
            found |= {r["rank"]: r["v"] for r in hit.select("w.rank", "v").collect()}  # a row a rank
        slack *= 4
    return found


def exact_quantiles(df: DataFrame, key: str, qs: dict[str, float], n: int, target: int) -> dict[str, float]:
    """Quantiles by linear interpolation between the two neighbouring ranks."""
    at = {a: (n - 1) * q for a, q in qs.items()}
    v = values_at(df, key, [r for p in at.values() for r in (math.floor(p), math.ceil(p))], n, target)
    return {a: v[math.floor(p)] + (v[math.ceil(p)] - v[math.floor(p)]) * (p - math.floor(p)) for a, p in at.items()}
