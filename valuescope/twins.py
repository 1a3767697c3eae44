"""DuckDB twins: the same computations written as plain SQL (test oracle).

``with_mart(body, extra)`` prefixes a statement with the CTE chain that
builds the user mart exactly as ``plans.mart.build_user_mart`` does.
"""

from __future__ import annotations

FEAT_DAYS = 180
LABEL_DAYS = 720

MART_CTES = f"""
od AS (
  SELECT o_custkey AS vopenid, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS prio, o_orderkey,
         o_orderstatus = 'F' AS paid, o_totalprice
  FROM orders WHERE o_custkey IS NOT NULL),
coh AS (SELECT vopenid, MIN(d) AS install_date FROM od GROUP BY vopenid),
ofe AS (
  SELECT coh.vopenid, coh.install_date,
    MIN(CASE WHEN od.d = coh.install_date THEN od.o_orderkey END) AS roleid,
    COUNT(CASE WHEN od.d < coh.install_date + {FEAT_DAYS} THEN 1 END) AS login_rows_d7,
    COUNT(DISTINCT CASE WHEN od.d < coh.install_date + {FEAT_DAYS} THEN od.d END) AS active_days_d7,
    COUNT(DISTINCT CASE WHEN od.d < coh.install_date + {FEAT_DAYS} THEN od.prio END) AS loginchannel_variety_d7,
    CAST(COALESCE(SUM(CASE WHEN od.d < coh.install_date + {FEAT_DAYS} AND od.paid
                       THEN CAST(od.o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS rev_d7,
    COUNT(CASE WHEN od.d < coh.install_date + {FEAT_DAYS} AND od.paid AND od.o_totalprice > 0 THEN 1 END) AS txn_cnt_d7,
    CAST(MIN(CASE WHEN od.d < coh.install_date + {FEAT_DAYS} AND od.paid AND od.o_totalprice > 0
             THEN date_diff('day', coh.install_date, od.d) END) AS INTEGER) AS first_charge_day_offset_d7,
    CAST(COALESCE(SUM(CASE WHEN od.paid THEN CAST(od.o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS ltv30
  FROM coh JOIN od ON od.vopenid = coh.vopenid AND od.d < coh.install_date + {LABEL_DAYS}
  GROUP BY coh.vopenid, coh.install_date),
gd AS (
  SELECT o.o_custkey AS vopenid, CAST(l.l_shipdate AS DATE) AS d, l.l_returnflag, l.l_quantity,
         l.l_extendedprice, l.l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
gfe AS (
  SELECT coh.vopenid, COUNT(*) AS g_games, COUNT(CASE WHEN gd.l_returnflag = 'R' THEN 1 END) AS g_wins,
    SUM(CAST(gd.l_quantity AS DECIMAL(18,2))) AS g_qty, SUM(CAST(gd.l_extendedprice AS DECIMAL(18,2))) AS g_score,
    CAST(SUM(gd.l_linenumber) AS BIGINT) AS g_lines, MAX(gd.l_linenumber) AS g_maxline
  FROM coh JOIN gd ON gd.vopenid = coh.vopenid AND gd.d >= coh.install_date
                   AND gd.d < coh.install_date + {FEAT_DAYS}
  GROUP BY coh.vopenid),
mart AS (
  SELECT ofe.vopenid, ofe.roleid, ofe.install_date, c.c_mktsegment AS media_source,
    n.n_name AS first_country_code, r.r_name AS first_os,
    ofe.login_rows_d7, ofe.active_days_d7, ofe.loginchannel_variety_d7,
    CAST(COALESCE(g.g_games, 0) AS BIGINT) AS games_d7,
    COALESCE(CAST(g.g_wins AS DOUBLE) / CAST(g.g_games AS DOUBLE), 0.0) AS win_rate_d7,
    COALESCE(CAST(g.g_qty AS DOUBLE) / CAST(g.g_games AS DOUBLE), 0.0) AS avg_game_duration_d7,
    COALESCE(CAST(g.g_score AS DOUBLE) / CAST(g.g_games AS DOUBLE), 0.0) AS avg_score_d7,
    COALESCE(CAST(g.g_qty AS DOUBLE), 0.0) AS kills_d7,
    CAST(COALESCE(g.g_lines, 0) AS BIGINT) AS deaths_d7,
    COALESCE(CAST(g.g_qty AS DOUBLE) / NULLIF(CAST(g.g_lines AS DOUBLE), 0.0), 0.0) AS kd_d7,
    CAST(COALESCE(g.g_maxline, 0) AS INTEGER) AS max_level_game_d7,
    ofe.rev_d7, ofe.txn_cnt_d7, ofe.first_charge_day_offset_d7, ofe.ltv30,
    CAST(ofe.ltv30 > 0 AS INTEGER) AS is_payer_30
  FROM ofe LEFT JOIN gfe g ON g.vopenid = ofe.vopenid
  LEFT JOIN customer c ON c.c_custkey = ofe.vopenid
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)
"""


def with_mart(body: str, extra: str = "") -> str:
    """``WITH <mart ctes>[, extra] body``."""
    ctes = MART_CTES.strip()
    if extra.strip():
        ctes = ctes + ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"


def r6(expr: str, alias: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias}"


def money_sum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def pct(num: str, den: str) -> str:
    """100 * num / den as double, null when den = 0 (same order as Spark)."""
    return f"(CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0.0))"


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0.0))"


def pearson(x: str, y: str) -> str:
    xx = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    yy = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return f"(COVAR_POP({xx}, {yy}) / NULLIF(STDDEV_POP({xx}) * STDDEV_POP({yy}), 0.0))"
