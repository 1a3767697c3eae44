"""Exact global rank, running sums and quantiles without a single-partition window.

A plain ``Window.orderBy(x)`` moves every row into one task. Instead:

1. count the rows; if the population fits one task (``bucket_rows``,
   session conf ``valuescope.rank.bucketRows``) a single ordered window is
   used — the size of that group is proven by the count;
2. otherwise bucket edges come from ``approx_percentile``; every edge value is a
   bucket of its own, and a value that covers more than one bucket (ties such
   as ltv = 0) is split again by ranges of the tie-break key (user id), so no
   bucket exceeds about ``bucket_rows`` rows whatever the skew. Rows find their
   bucket by binary search in the edge list;
3. ``row_number`` / running sum inside each bucket, plus the offsets of the
   preceding buckets from a frame of bucket totals. Edges and totals exist only
   for populations beyond one bucket, and are broadcast up to a stated size.

The order is total (value, then tie-break), so ranks are deterministic and
the same on recomputation after an executor loss.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ensure_checkpoint_dir
from .selection import exact_quantiles

DEFAULT_BUCKET_ROWS = 2_000_000
#: Edge lists and bucket totals up to this many entries (8 bytes each and a key) are broadcast; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 1_000_000


def bucket_rows(spark) -> int:
    return int(spark.conf.get("valuescope.rank.bucketRows", str(DEFAULT_BUCKET_ROWS)))


@dataclass
class Ranked:
    df: DataFrame      # input columns + rn (1-based) [+ cum]
    n: int             # number of ranked rows (all groups)
    counts: DataFrame | None = None  # (group, c): rows per group when grouped


def _doubles(values: list[float]) -> Column:
    """Array literal in one expression, however long the list."""
    if not values:
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _count_le(edges: Column, x: Column, most: int) -> Column:
    """How many of the sorted ``edges`` (at most ``most``) are <= x: binary search by halving steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(edges)) & (F.get(edges, at + step - 1) <= x), at + step).otherwise(at))


def _position(edges: Column, x: Column, most: int) -> Column:
    """2i between two edges and 2i + 1 on an edge, so every edge value has a bucket of its own."""
    le = _count_le(edges, x, most)
    return F.lit(2) * le - F.when(F.get(edges, le - 1) == x, 1).otherwise(0)


def _order_number(df: DataFrame, tiebreak: str) -> Column:
    """A number that never decreases in the order of the tie-break key.

    Strings compare by their bytes, so six bytes after the prefix that all values share order them (values
    that agree there stay in one bucket and are ordered inside it).
    """
    c = F.col(tiebreak)
    if not isinstance(df.schema[tiebreak].dataType, StringType):
        return c.cast("double")
    lo, hi = df.agg(F.min(F.encode(c, "utf-8")), F.max(F.encode(c, "utf-8"))).first()
    shared = len(os.path.commonprefix([bytes(lo or b""), bytes(hi or b"")]))
    head = F.hex(F.substring(F.encode(c, "utf-8"), shared + 1, 6))
    return F.coalesce(F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _fixed(df: DataFrame) -> DataFrame:
    """Sketch results written to the shared folder: a second evaluation would give other edges."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _edges(df: DataFrame, group: list[str], key: str, tiebreak: str, nb: int) -> DataFrame:
    """(group…, e, heavy): sorted distinct edges, and per value that covers more than one bucket its tie-break edges."""
    acc = max(10000, 20 * nb)
    kc = F.col(key).cast("double")
    raw = df.groupBy(*group).agg(F.percentile_approx(kc, [i / nb for i in range(1, nb)], acc).alias("q"))
    raw = raw.select(*group, F.explode("q").alias("v")).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    raw = _fixed(raw)
    edges = raw.groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("e"))
    most = raw.agg(F.max("c")).first()[0] or 1
    if most < 2:
        return edges.withColumn("heavy", F.lit(None).cast("map<double,array<double>>"))
    ties = raw.where("c > 1").select(*[F.col(g).alias(f"_{g}") for g in group], F.col("v").alias("_v"))
    on = (kc == F.col("_v"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    cuts = [j / (most + 1) for j in range(1, most + 1)]
    # at most one tie per two buckets
    inside = df.join(F.broadcast(ties), on).groupBy(*group, "_v").agg(
        F.array_distinct(F.percentile_approx(_order_number(df, tiebreak), cuts, acc)).alias("t"))
    heavy = inside.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(
        F.map_from_entries(F.collect_list(F.struct("_v", "t"))).alias("heavy"))
    if not group:  # one row
        return edges.withColumn("heavy", heavy.scalar())
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return edges.join(heavy, on, "left").select(*group, "e", "heavy")


def _bucketed(df: DataFrame, key: str, tiebreak: str, desc: bool, target: int, group: str | None, n: int,
              sizes: DataFrame | None) -> tuple[DataFrame, bool]:
    """``df`` with _b, _s (bucket and its part, both in rank order), null in groups that fit one bucket; and
    whether the totals per bucket are few enough to broadcast."""
    kc = F.col(key).cast("double")
    if group is None:
        nb = math.ceil(n / target)
        row = _edges(df, [], key, tiebreak, nb).first()
        e = sorted(float(v) for v in row["e"])
        b = _position(_doubles(e), kc, nb)
        ties = {float(v): sorted(float(x) for x in t) for v, t in (row["heavy"] or {}).items()}
        part = F.lit(0)
        if ties:
            pairs = [c for v, t in ties.items() for c in (F.lit(v), _doubles(t))]
            cuts = F.try_element_at(F.create_map(*pairs), kc)
            part = F.coalesce(_count_le(cuts, _order_number(df, tiebreak), max(map(len, ties.values()))), F.lit(0))
        return df.withColumns({"_b": -b if desc else b, "_s": part}), 4 * nb <= BROADCAST_ENTRIES
    big = sizes.where(F.col("c") > target).select(F.col(group).alias("_g"))  # at most n / target rows
    big_n, top = sizes.where(F.col("c") > target).agg(F.count(F.lit(1)), F.max("c")).first()
    nb = math.ceil(top / target)
    few = big_n * nb * 4 <= BROADCAST_ENTRIES
    held = df.join(F.broadcast(big) if few else big, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    plan = _fixed(_edges(held, [group], key, tiebreak, nb)).withColumnRenamed(group, "_g")
    x = df.join(F.broadcast(plan) if few else plan, F.col(group).eqNullSafe(F.col("_g")), "left")
    b = _position(F.col("e"), kc, nb)
    part = F.coalesce(_count_le(F.try_element_at(F.col("heavy"), kc), _order_number(df, tiebreak), nb), F.lit(0))
    held = F.col("e").isNotNull()
    x = x.withColumns({"_b": F.when(held, -b if desc else b), "_s": F.when(held, part)})
    return x.drop("_g", "e", "heavy"), few


def global_rank(df: DataFrame, key: str, desc: bool = True, tiebreak: str = "vopenid",
                measure: str | None = None, target: int | None = None, n: int | None = None,
                money: bool = True, group: str | None = None, extra: list[str] | None = None) -> Ranked:
    """Add ``rn`` (1-based position in the order key, tiebreak) and, with
    ``measure``, ``cum`` (running sum of the measure up to the row).

    With ``group`` the order restarts in every group, the null group included
    (one pass for all groups, e.g. one rank per strategy or per feature). Rows
    with a null key are dropped. ``money`` sums the measure as DECIMAL(18,2)
    (exact). ``extra``: more columns to accumulate (as double) into ``cum_<name>``.
    """
    extra = extra or []
    target = target or bucket_rows(df.sparkSession)
    df = df.where(F.col(key).isNotNull())
    sizes = None
    if group is None:
        n = df.count() if n is None else n
        single = n <= target
    else:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("c"))
        top, n = sizes.agg(F.max("c"), F.sum("c")).first()
        single = (top or 0) <= target
    x, few = (df, True) if single else _bucketed(df, key, tiebreak, desc, target, group, n, sizes)
    parts = ([group] if group else []) + ([] if single else ["_b", "_s"])
    order = [F.col(key).desc() if desc else F.col(key).asc(), F.col(tiebreak).asc()]
    # the population fits one bucket (size proven by the count): a plain ordered window
    w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*order)
    if measure:
        m = F.col(measure).cast("decimal(18,2)") if money else F.col(measure).cast("double")
        x = x.withColumn("_m", m)
    x = x.withColumn("_rl", F.row_number().over(w))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if measure:
        x = x.withColumn("_cl", F.sum("_m").over(frame))
    for e in extra:
        x = x.withColumn(f"_cl_{e}", F.sum(F.col(e).cast("double")).over(frame))
    if single:
        x = x.withColumn("rn", F.col("_rl").cast("bigint"))
        if measure:
            x = x.withColumn("cum", F.col("_cl").cast("double"))
        for e in extra:
            x = x.withColumn(f"cum_{e}", F.col(f"_cl_{e}"))
    else:
        aggs = [F.count(F.lit(1)).alias("_on")]
        if measure:
            aggs.append(F.sum("_m").alias("_os"))
        aggs += [F.sum(F.col(e).cast("double")).alias(f"_os_{e}") for e in extra]
        # one row per bucket of the groups beyond one bucket; groups that fit one have no offset
        tot = x.where(F.col("_b").isNotNull()).groupBy(*parts).agg(*aggs)
        wo = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_b", "_s") \
            .rowsBetween(Window.unboundedPreceding, -1)
        sums = ["_on"] + (["_os"] if measure else []) + [f"_os_{e}" for e in extra]
        tot = tot.select(*[F.col(c).alias(f"_t{c}") for c in parts], *[F.sum(c).over(wo).alias(c) for c in sums])
        on = (F.col("_b") == F.col("_t_b")) & (F.col("_s") == F.col("_t_s"))
        if group:
            on = on & F.col(group).eqNullSafe(F.col(f"_t{group}"))
        x = x.join(F.broadcast(tot) if few else tot, on, "left").drop(*[f"_t{c}" for c in parts])
        x = x.withColumn("rn", (F.coalesce("_on", F.lit(0)) + F.col("_rl")).cast("bigint"))
        if measure:
            zero = F.lit(0).cast("decimal(38,2)") if money else F.lit(0.0)
            x = x.withColumn("cum", (F.coalesce("_os", zero) + F.col("_cl")).cast("double"))
        for e in extra:
            x = x.withColumn(f"cum_{e}", F.coalesce(F.col(f"_os_{e}"), F.lit(0.0)) + F.col(f"_cl_{e}"))
    drop = ["_b", "_s", "_rl", "_cl", "_on", "_os", "_m"] + [f"_{k}_{e}" for e in extra for k in ("cl", "os")]
    return Ranked(x.drop(*drop), n or 0, sizes)


def quantiles(df: DataFrame, key: str, qs: dict[str, float], tiebreak: str = "vopenid",
              target: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (= percentile_cont) as a 1-row frame.

    Small populations (≤ bucket_rows, proven by a count) use the built-in
    exact ``percentile``; larger ones pick the needed positions by exact
    selection (two scans, no sort, see ``selection``), so no task ever holds
    the whole column.
    """
    spark = df.sparkSession
    target = target or bucket_rows(spark)
    base = df.where(F.col(key).isNotNull())
    n = base.count()
    if n <= target:
        return base.agg(*[F.percentile(F.col(key).cast("double"), q).alias(a) for a, q in qs.items()]) \
            if n > 0 else spark.range(1).select(*[F.lit(None).cast("double").alias(a) for a in qs])
    v = exact_quantiles(base, key, qs, n, target)
    return spark.range(1).select(*[F.lit(x).cast("double").alias(a) for a, x in v.items()])


def cutoff_values(df: DataFrame, key: str, qs: dict[str, float], where: Column | None = None,
                  tiebreak: str = "vopenid") -> dict[str, float | None]:
    """Exact quantile cutoffs as Python floats (one bounded row collected).

    Inlined as literals, the cutoffs fold into filters that reach the scan.
    """
    base = df.where(where) if where is not None else df
    row = quantiles(base.select(key, tiebreak), key, qs, tiebreak=tiebreak).first()
    return {a: (None if row is None else row[a]) for a in qs}


def mid_rank_values(df: DataFrame, key: str, out: str, group: str | None = None, **sums: Column) -> DataFrame:
    """One row per distinct value of ``key`` (and group): how many rows have it (_c), the rows of its group (_n),
    its 1-based mid-rank ``out`` (ties share the mean rank), and the aggregates ``sums`` of its rows.

    Partial aggregation collapses hot values such as 0 before anything is ranked. A statistic that needs ranks only
    in sums takes them from this frame, and no row is joined back on its value. Null keys have no rank.
    """
    g = [group] if group else []
    d = df.where(F.col(key).isNotNull()).groupBy(*g, key).agg(F.count(F.lit(1)).alias("_c"), *[c.alias(k) for k, c in sums.items()])
    x = global_rank(d, key, desc=False, tiebreak=key, measure="_c", money=False, group=group).df
    x = x.withColumn(out, F.col("cum") - F.col("_c") + (F.col("_c") + F.lit(1.0)) / F.lit(2.0)).drop("cum", "rn")
    if not group:
        return x.withColumn("_n", F.lit(d.agg(F.sum("_c")).first()[0] or 0))
    n = d.groupBy(F.col(group).alias("_g")).agg(F.sum("_c").alias("_n"))
    return x.join(n, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def mid_ranks(df: DataFrame, key: str, out: str, group: str | None = None, centred: bool = False) -> DataFrame:
    """Attach the mid-rank of ``key``; ``centred``: less the mean rank of the group, so that equal values all get 0.

    The ranks of the distinct values (see ``mid_rank_values``) are joined back on the value; a hot value meets a
    single row on the other side, which AQE's skew join splits.
    """
    g = [group] if group else []
    r = mid_rank_values(df.select(*g, key), key, "_r", group=group)
    rank = F.col("_r") - (F.col("_n") + F.lit(1.0)) / F.lit(2.0) if centred else F.col("_r")
    rk = r.select(*[F.col(c).alias(f"_r{c}") for c in g], F.col(key).alias("_rk"), rank.alias(out))
    on = F.col(key) == F.col("_rk")
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return df.join(rk, on, "left").drop("_rk", *[f"_r{c}" for c in g])


def rank_sums(y: str) -> dict[str, Column]:
    """What ``mid_rank_values`` has to add up for ``rank_correlation`` with the centred ranks ``y``."""
    return {"_p": F.count(y), "_y": F.sum(y), "_yy": F.sum(F.col(y) * F.col(y))}


def rank_correlation(rank: str) -> Column:
    """Spearman's rho as an aggregate over a frame of ``mid_rank_values`` with ``rank_sums``; null if one side is constant."""
    d = F.col(rank) - (F.col("_n") + F.lit(1.0)) / F.lit(2.0)
    n = F.nullif(F.sum("_p").cast("double"), F.lit(0.0))
    mx, my = F.try_divide(F.sum(F.col("_p") * d), n), F.try_divide(F.sum("_y"), n)
    vx, vy = F.try_divide(F.sum(F.col("_p") * d * d), n) - mx * mx, F.try_divide(F.sum("_yy"), n) - my * my
    both = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
    return F.try_divide(F.try_divide(F.sum(d * F.col("_y")), n) - mx * my, F.nullif(both, F.lit(0.0)))


def prefix_sums_at(ranked: Ranked, positions: list[int]) -> DataFrame:
    """(pos, cum) for each requested 1-based position; pos 0 → 0.

    The position list is bounded (a curve has ≤ a few hundred points) and
    derived from the row count, so it is broadcast.
    """
    spark = ranked.df.sparkSession
    pos = spark.createDataFrame([(int(p),) for p in sorted(set(positions))], "pos bigint")
    hits = ranked.df.where(F.col("rn").isin(sorted({p for p in positions if p > 0}) or [-1])) \
        .select(F.col("rn").alias("pos"), "cum")
    return pos.join(F.broadcast(hits), "pos", "left").select("pos", F.coalesce("cum", F.lit(0.0)).alias("cum"))


def group_quantiles(df: DataFrame, group: str | None, key: str, qs: dict[str, float],
                    tiebreak: str = "vopenid", target: int | None = None) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) as a frame (group, alias…).

    When the largest group has at most ``bucket_rows`` distinct values
    (checked with a sketch) Spark's exact ``percentile`` aggregate is used —
    its memory is one counter per distinct value. Otherwise the values are
    ranked inside each group with the bucketed rank and the interpolation
    positions of every group (a frame of #groups × #quantiles rows, broadcast)
    pick the two neighbouring values; no group is ever held in one task.
    """
    spark = df.sparkSession
    target = target or bucket_rows(spark)
    base = df.where(F.col(key).isNotNull())
    gcols = [group] if group else []
    g = base.groupBy(*gcols)
    mx = g.agg(F.approx_count_distinct(key).alias("d")).agg(F.max("d")).first()[0] or 0
    if mx <= target:
        return g.agg(*[F.percentile(F.col(key).cast("double"), q).alias(a) for a, q in qs.items()])
    if group is None:
        return quantiles(base, key, qs, tiebreak=tiebreak, target=target)
    r = global_rank(base.select(group, key, tiebreak), key, desc=False, tiebreak=tiebreak, group=group,
                    target=target)
    asked = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(float(q)).alias("q")) for a, q in qs.items()])
    at = (F.col("c") - 1) * F.col("w.q")
    pos = r.counts.select(F.col(group).alias("_g"), "c", F.explode(asked).alias("w")).select(
        "_g", "w.alias", (F.floor(at) + 1).alias("lo"), (F.ceil(at) + 1).alias("hi"), (at - F.floor(at)).alias("frac"))
    if r.counts.count() * len(qs) <= BROADCAST_ENTRIES:
        pos = F.broadcast(pos)
    j = r.df.select(group, "rn", F.col(key).cast("double").alias("v")).join(pos, F.col(group).eqNullSafe(F.col("_g"))) \
        .where((F.col("rn") == F.col("lo")) | (F.col("rn") == F.col("hi")))
    per = j.groupBy(group, "alias", "frac").agg(
        F.max(F.when(F.col("rn") == F.col("lo"), F.col("v"))).alias("vlo"),
        F.max(F.when(F.col("rn") == F.col("hi"), F.col("v"))).alias("vhi"))
    per = per.withColumn("val", F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac"))
    return per.groupBy(group).agg(*[F.max(F.when(F.col("alias") == a, F.col("val"))).alias(a) for a in qs])
