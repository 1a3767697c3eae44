"""Column helpers shared by all jobs (all JVM-side expressions).

Conventions kept identical to the DuckDB twins so results hash equal:
money is summed as DECIMAL(18,2) and cast to double at the end, ratios are
double arithmetic in a fixed operand order, doubles are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c) -> Column:
    """Exact sum of a 2-decimal money column, returned as double."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def money_avg(c) -> Column:
    """Mean of a money column from the exact decimal sum."""
    return F.try_divide(money_sum(c), F.count(col(c)).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den in double, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def pct(num: Column, den: Column) -> Column:
    """100 * num / den with the same operand order as the SQL twin."""
    return F.try_divide(num.cast("double") * F.lit(100.0), F.nullif(den.cast("double"), F.lit(0.0)))


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def pearson(x, y) -> Column:
    """Null-safe Pearson: null on a constant column instead of an ANSI error."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.nullif(F.stddev_pop(xx) * F.stddev_pop(yy), F.lit(0.0)))


def r6(c) -> Column:
    """Round half up to 6 decimals as floor(x*1e6 + 0.5)/1e6.

    Written as plain IEEE operations so that Spark and the SQL twin produce
    bit-identical doubles (the engines' ROUND functions break ties
    differently).
    """
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) > F.lit(1e15)), x) \
        .otherwise(F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (result presentation)."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs[f.name] = r6(f.name)
    return df.withColumns(exprs) if exprs else df


def ladder(value: Column, edges, labels, right_closed: bool = True, include_lowest: bool = False,
           default=None) -> Column:
    """Fixed-bin bucketing as a `when` ladder.

    ``edges`` has len(labels)+1 entries. right_closed=True gives (a, b]
    bins (pandas ``cut`` default); include_lowest closes the first bin on
    the left too. right_closed=False gives [a, b).
    """
    out = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if right_closed:
            lo_ok = (value >= F.lit(lo)) if (include_lowest and i == 0) else (value > F.lit(lo))
            cond = lo_ok & (value <= F.lit(hi))
        else:
            cond = (value >= F.lit(lo)) & (value < F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(default))
